"""Word lists, patterns and limits that decide results."""

from __future__ import annotations

#: Section labels, and header texts with the section they open, in the order in which they are tried.
SECTION_LABELS = ["summary", "work_experience", "internships", "projects", "education", "skills", "achievements", "responsibility", "courses", "certifications", "publications", "patents", "workshops", "interests", "other"]
HEADERS = [
    ("work_experience", ["experience", "work experience", "professional experience", "employment", "work history", "career history", "professional background", "career experience", "job experience"]),
    ("internships", ["internship", "internships", "internship experience", "training"]),
    ("projects", ["projects", "personal projects", "academic projects", "notable projects"]),
    ("education", ["education", "academics", "academic background", "educational qualifications", "qualifications"]),
    ("skills", ["skills", "technical skills", "key skills", "professional skills", "core competencies", "competencies", "skill set", "tools & technologies", "technology stack", "tech skills", "technologies"]),
    ("achievements", ["honors", "honours", "awards", "honors & awards", "honours & awards", "recognitions", "achievements"]),
    ("certifications", ["certifications", "certificates", "licenses", "accreditations"]),
    ("publications", ["publications", "research papers", "research publications"]),
    ("patents", ["patents", "intellectual property"]),
    ("workshops", ["workshops", "seminars", "training programs"]),
    ("interests", ["interests", "hobbies", "personal interests"]),
    ("responsibility", ["responsibilities", "positions of responsibility", "leadership roles", "leadership positions", "roles and responsibilities"]),
]
#: Skills, titles and languages that are looked for.
SKILLS = ["python", "c", "c++", "java", "sql", "pandas", "numpy", "scikit-learn", "tensorflow", "pytorch", "langchain", "streamlit", "django", "flask", "javascript", "html", "css", "tableau", "excel", "git", "github", "linux", "docker", "kubernetes", "figma", "google analytics", "mixpanel", "phonepe", "aws", "gcp", "azure", "postgresql", "mysql", "power bi", "matlab", "autocad", "revit", "staad pro"]
TITLES = ["software engineer", "sde", "sde i", "sde ii", "senior software engineer", "data scientist", "data analyst", "ml engineer", "machine learning engineer", "product manager", "technical product manager", "intern", "research intern", "frontend engineer", "backend engineer", "full stack engineer", "devops engineer"]
LANGUAGES = ["english", "hindi", "french", "german", "spanish", "malayalam", "tamil", "telugu"]
#: Patterns of contacts and dates.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)?\d{3,4}[\s-]?\d{3,4})"
URL = r"(https?://\S+|www\.\S+)"
LINKEDIN, GITHUB = r"(?i)(linkedin\.com/[A-Za-z0-9_/\-]+)", r"(?i)(github\.com/[A-Za-z0-9_\-]+)"
YEAR_RANGE = r"\b(?:19|20)\d{2}\s*[-–—]\s*(?:19|20)\d{2}\b"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SEASONS = [("spring", "03"), ("summer", "06"), ("autumn", "09"), ("fall", "09"), ("winter", "12")]
BULLET_MARKS = ["•", "●", "◦", "▪", "·", "-", "–", "—"]
#: Limits of retrieval and matching.
PER_QUERY, RRF_K, POOL, SIMPLE_POOL, TOP_K = 30, 60, 50, 30, 10
WEIGHT_QUERY, WEIGHT_HYDE, WEIGHT_SUB = 1.7, 1.15, 1.0
KEEP_SCORE, KEEP_DISTANCE, SIMPLE_DISTANCE = 0.15, 0.95, 0.9
MMR_LAMBDA, MMR_CAP = 0.65, 200
NAME_CUTOFF, SKILL_CUTOFF, ROLE_CUTOFF, DEGREE_CUTOFF, TITLE_CUTOFF, HEADER_CUTOFF = 85, 87, 90, 92, 88, 80
CHUNK, OVERLAP, LEAST_CHUNK = 900, 200, 60
SEPARATORS = ("\n\n", "\n• ", "\n- ", "\n", " ", "")
SECTION_WEIGHTS = {"experience": 0.5, "skills": 0.3, "education": 0.2, "other": 0.1}
LEAST_CONFIDENCE = 0.45
STOP_NAMES = ["the", "and", "for", "with", "who", "what", "are"]

#: Words that start a role line, company words, degree and institute words, titles that wrap, and glyphs.
ROLE_CUES = ["Senior", "Lead", "Staff", "Principal", "Associate", "Junior", "Software", "Data", "Machine", "AI", "ML", "NLP", "Computer", "Product", "Engineer", "Scientist", "Consultant", "Analyst", "Manager", "Decision Scientist", "R&D", "Research", "Architect"]
COMPANY_CUES = ["Inc", "Ltd", "LLC", "GmbH", "Pvt", "Technologies", "Labs", "Analytics", "Sigma", "Gupshup", "Fractal", "Mu Sigma"]
DEGREE_START = r"(?i)^(?:B\.?\s?Tech\.?|B\.?\s?E\.?|B\.?\s?Sc\.?|M\.?\s?Tech\.?|M\.?\s?S\.?|M\.?\s?Sc\.?|Bachelor(?:'s|s)?|Master(?:'s|s)?)(?:\b|\s|$)"
INSTITUTE = r"(?i)\b(?:University|College|Institute|Academy|School|IIT|NIT|SRM)\b"
TITLE_START = r"(?i)^(?:Intern|Trainee|Associate|Senior|Junior|Lead|Staff|Principal)\b"
AWARDS_HEADER, AWARD_START = r"(?i)\b(?:AWARDS?|HONORS?)\b", r"(?i)^(?:Star Award|Spot Award|Impact Award|[A-Z][A-Za-z0-9 .,&/+-]{0,60}\b(?:Award|Scholarship|Fellowship|Prize))"
SECTION_START = r"(?i)^(?:Education|Experience|Work Experience|Projects|Skills|Certifications?|Publications?)\b"
BULLET_GLYPHS = "•·●◦▪▸►▫-–—⋆★☆■□◆❖»›"
EXOTIC_BULLETS = "⋆★☆◆◇■□❖▶▸►▪▫•·●◦»›¤¢§"
ICONS = {"faAt": "Email:", "faPhone": "Phone:", "faMapMarker": "Location:", "faLinkedin": "LinkedIn:"}
#: Header texts of the rule-based sectioner.
RULE_HEADERS = [
    ("work_experience", ["work experience", "experience", "professional experience", "employment history", "career history", "work history"]),
    ("internships", ["internships", "internship experience", "internship", "industrial training"]),
    ("projects", ["projects", "personal projects", "academic projects", "project work"]),
    ("education", ["education", "educational qualification", "academics", "academic profile"]),
    ("skills", ["skills", "technical skills", "skill set", "core competencies", "software proficiency", "tools"]),
    ("courses", ["courses", "relevant courses", "coursework", "relevant coursework"]),
    ("certifications", ["certifications", "certification", "licenses", "licenses & certifications", "certificates"]),
    ("achievements", ["achievements", "awards", "accomplishments", "honors"]),
    ("responsibility", ["positions of responsibility", "leadership", "responsibilities", "position of responsibility", "por", "co-curricular activities", "extra-curricular activities"]),
    ("interests", ["interests", "hobbies"]),
    ("summary", ["summary", "professional summary", "objective", "profile"]),
]
PROSE_VERBS = r"(?i)\b(?:implemented|built|developed|designed|evaluated|led|leading|managing|created|optimized|deployed|research(?:ed|ing))\b"

#: Vocabularies of a question's entities, and words that hint at a section.
QUERY_SKILLS = ["python", "django", "flask", "fastapi", "react", "node", "javascript", "typescript", "aws", "gcp", "azure", "docker", "kubernetes", "k8s", "grpc", "redis", "postgres", "mysql", "spark", "hadoop", "snowflake", "dbt", "pytorch", "tensorflow", "keras", "scikit-learn", "opencv", "cuda", "tensorrt", "triton", "yolov7", "yolov5", "zed", "ros", "ros2", "triton inference server"]
QUERY_ROLES = ["backend engineer", "backend developer", "frontend engineer", "frontend developer", "full stack", "full stack developer", "data engineer", "ml engineer", "machine learning engineer", "data scientist", "ios developer", "android developer", "devops", "sre", "site reliability engineer"]
QUERY_DEGREES = ["btech", "be", "b.e.", "mtech", "m.tech", "mca", "bca", "bsc", "msc", "mba", "phd", "ph.d."]
SECTION_HINTS = [
    ("experience", ["experience", "worked at", "role", "roles", "position", "positions"]),
    ("project", ["project", "projects"]),
    ("education", ["education", "degree", "college", "university"]),
    ("skills", ["skills", "tech stack", "stack"]),
    ("achievement", ["achievement", "awards", "accomplishment"]),
]

def header_entries() -> list[tuple[int, str, str]]:
    """(order, header text, label) in the order in which they are tried."""
    flat = [(key, label) for label, keys in HEADERS for key in keys]
    return [(i, key, label) for i, (key, label) in enumerate(flat)]
