"""The canonical record of a person, its fan-out to tables, and table changes as pure functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions import fuzzy
from talentweave.functions import lexicon as L
from talentweave.functions import text as X
from talentweave.operators.dealing import dealt, parts

#: The canonical record, which is also the extractor's output with `meta` in place of hash and parser fields.
EXTRACTED = """
meta STRUCT<source_path:STRING>,
candidate STRUCT<full_name:STRING, emails:ARRAY<STRING>, phones:ARRAY<STRING>, links:STRUCT<linkedin:STRING,github:STRING>>,
experience ARRAY<STRUCT<company_raw:STRING, company_norm:STRING, title_raw:STRING, title_norm:STRING, seniority:STRING, employment_type:STRING, location:STRING, start_date:STRING, end_date:STRING, is_current:BOOLEAN, extraction_confidence:DOUBLE, source_page:INT, bullets:ARRAY<STRUCT<bullet_text:STRING, metrics:MAP<STRING,INT>, skills_mentioned:ARRAY<STRING>, source_page:INT>>>>,
education ARRAY<STRUCT<degree_raw:STRING, degree_level:STRING, field_raw:STRING, institution_raw:STRING, start_date:STRING, end_date:STRING, gpa:STRING, extraction_confidence:DOUBLE, source_page:INT>>,
skills ARRAY<STRUCT<name:STRING, category:STRING>>,
projects ARRAY<STRUCT<name:STRING, summary:STRING, role:STRING, tech_stack:ARRAY<STRING>, start_date:STRING, end_date:STRING, repo_url:STRING, impact_metrics:MAP<STRING,INT>, source_page:INT>>,
certifications ARRAY<STRUCT<name:STRING, summary:STRING, issue_date:STRING, credential_id:STRING, url:STRING>>,
publications ARRAY<STRUCT<title:STRING, year:INT, url:STRING>>,
achievements ARRAY<STRING>,
languages ARRAY<STRUCT<name:STRING, level:STRING>>,
sectioned_text ARRAY<STRUCT<section_type:STRING, text:STRING, page_range:ARRAY<INT>>>
"""


def canonical(docs: DataFrame, parsed_at: Column, parser_version: str = "v0.1.0") -> DataFrame:
    """Extractor output to canonical records; phones are normalised here and nowhere else, dates stay as extracted."""
    c = F.col("candidate")
    phones = F.sort_array(F.array_distinct(F.transform(F.filter(c["phones"], lambda p: X.valid_phone(p)), lambda p: X.normal_phone(p))))
    person = F.struct(
        c["full_name"].alias("full_name"), F.sort_array(F.array_distinct(c["emails"])).alias("emails"), phones.alias("phones"),
        F.struct(*[F.lit(None).cast("string").alias(n) for n in ("city", "state", "country")]).alias("location"), c["links"].alias("links"),
        X.document_hash(F.transform("sectioned_text", lambda s: F.coalesce(s["text"], F.lit("")))).alias("resume_text_hash"),
        X.first_filled(X.basename(F.col("meta.source_path"))).alias("source_file_id"), parsed_at.alias("parsed_at"), F.lit(parser_version).alias("parser_version"),
    )
    kind = lambda e: F.coalesce(e["employment_type"], X.employment_type(F.concat_ws(" ", e["title_raw"], e["title_norm"])))
    work = F.transform("experience", lambda e: e.withField("employment_type", kind(e)).withField("is_current", F.coalesce(e["is_current"], F.lit(False))).withField("extraction_confidence", F.coalesce(e["extraction_confidence"], F.lit(0.0))))
    return docs.withColumns({"candidate": person, "experience": work}).drop("meta")


#: The systems whose entities count, the preferred one first.
SYSTEMS = ("hf", "spacy")
#: Where a work header is cut for its title.
TITLE_CUTS = r"[|,•\-–—@/()]"


def standing(entities: DataFrame, n: int | None = None) -> DataFrame:
    """Entities (doc_id, sec_no, system, label, word, start, end, score) that no better one of their system overlaps: one
    with a higher score, or with an equal one that starts earlier or, from the same place, ends later. Offsets are code
    points of the section's text, ends exclusive; labels come in capitals, words trimmed, those without text go.

    Entities meet in the stretches of 128 code points that they touch, so that only near ones are compared. All of it
    happens where a document's entities have been dealt to, once, in n partitions (else as many as they need).
    """
    keys, rest = ["doc_id", "sec_no", "system"], ["label", "word", "start", "end", "score"]
    df = dealt(entities, n or parts(entities), "doc_id").withColumns({"label": F.upper("label"), "word": F.trim("word")}).where((F.col("word") != "") & (F.col("start") < F.col("end")))
    places = F.explode(F.sequence(F.floor(F.col("start") / 128), F.floor((F.col("end") - 1) / 128))).alias("_at")
    rank = F.struct((-F.coalesce("score", F.lit(0.0))).alias("a"), F.col("start").alias("b"), (-F.col("end")).alias("c"), F.col("label").alias("d"), F.col("word").alias("e"))
    near = df.select(*keys, F.struct(*rest, rank.alias("rank")).alias("e"), places).groupBy(*keys, "_at").agg(F.collect_set("e").alias("_near"))
    beats = lambda o: (o["start"] < F.col("e.end")) & (o["end"] > F.col("e.start")) & (o["rank"] < F.col("e.rank"))
    each = near.select(*keys, "_near", F.explode("_near").alias("e")).select(*keys, "e", F.exists("_near", beats).alias("_beaten"))
    return each.groupBy(*keys, "e").agg(F.max("_beaten").alias("_beaten")).where("not _beaten").select(*keys, *[f"e.{c}" for c in rest])


#: Sections of a partition, about.
SECTIONS = 50_000


def _blocks(sections: DataFrame, n: int | None, separator: str = r"\n{2,}") -> DataFrame:
    """(doc_id, sec_no, block_no, block, from_, head_from, head_to): the blocks of each section's text with their offset
    in it, and the offsets of their first line that is not blank; sections are dealt to n partitions."""
    lead = F.length("text") - F.length(F.ltrim("text"))
    own = dealt(sections.where("text is not null").select("doc_id", "sec_no", "text"), n, "doc_id")
    cut = own.select("doc_id", "sec_no", lead.alias("_lead"), X.blocks(F.col("text")).alias("_b"), F.regexp_extract_all(F.trim("text"), F.lit(f"({separator})"), F.lit(1)).alias("_s"))
    each = cut.select("doc_id", "sec_no", "_lead", "_s", F.posexplode("_b").alias("block_no", "block"))
    width = F.length("block") + F.coalesce(F.length(F.get("_s", F.col("block_no"))), F.lit(0))
    before = F.coalesce(F.sum(width).over(Window.partitionBy("doc_id", "sec_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    skipped = F.length(F.regexp_extract("block", r"^(?:[^\S\n]*\n)*", 0))
    placed = each.withColumn("from_", F.col("_lead") + before).withColumn("head_from", F.col("from_") + skipped)
    head = F.length(F.regexp_extract("block", r"^(?:[^\S\n]*\n)*([^\n]*)", 1))
    return placed.withColumn("head_to", F.col("head_from") + head).select("doc_id", "sec_no", "block_no", "block", "from_", "head_from", "head_to")


def named_in(blocks: DataFrame, entities: DataFrame, label: str, systems: tuple[str, ...], begin: str, end: str) -> DataFrame:
    """blocks with `named`: of each block the first entity of a label that lies inside its range, of the first listed
    system that has one there. A section's entities meet its blocks as one list."""
    order = F.coalesce(*[F.when(F.col("system") == s, F.lit(i)) for i, s in enumerate(systems)])
    wanted = entities.where((F.col("label") == label) & F.col("system").isin(*systems)).groupBy("doc_id", "sec_no").agg(F.collect_list(F.struct(order.alias("_o"), "start", "end", "word")).alias("_w"))
    inside = F.filter("_w", lambda e: (e["start"] >= F.col(begin)) & (e["end"] <= F.col(end)))
    return blocks.join(wanted, ["doc_id", "sec_no"], "left").withColumn("named", F.array_min(inside)["word"]).drop("_w")


def _with_names(blocks: DataFrame, n: int | None, entities: DataFrame | None, systems: tuple[str, ...], begin: str, end: str) -> DataFrame:
    if entities is None:
        return blocks.withColumn("named", F.lit(None).cast("string"))
    return named_in(blocks, standing(entities, n), "ORG", systems, begin, end)


def extract_experience(sections: DataFrame, entities: DataFrame | None = None, systems: tuple[str, ...] = SYSTEMS, strict_dates: bool = False) -> DataFrame:
    """(doc_id, sec_no, block_no, …) of the blocks of work sections: title, company, dates, bullets, confidence.

    The company is the first organisation that the preferred system has found in the block's header (entities: see
    standing), else what the header's words tell. A title is a listed one that the header contains, the longest, else
    the one that its first piece comes close to. systems: one system alone gives that extractor's variant.
    """
    work = sections.where(F.col("section_type").isin("work_experience", "internships"))
    n = parts(work, SECTIONS)
    work = _with_names(_blocks(work, n), n, entities, systems, "head_from", "head_to")
    own = X.lines(F.col("block"))
    df = work.withColumns({"header": X.collapse(F.get(own, F.lit(0))), "body": F.array_join(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), "\n")}).where("header is not null")
    lower = F.lower("header")
    title = F.coalesce(*[F.when(F.contains(lower, F.lit(t)) & lower.rlike(rf"(?:^|[^a-z]){t}(?:$|[^a-z])"), F.lit(t)) for t in sorted(L.TITLES, key=lambda t: (-len(t), t))])
    close = fuzzy.closest_piece(F.when(F.col("title").isNull(), F.col("header")), TITLE_CUTS, L.TITLES, fuzzy.token_set_ratio_of, L.TITLE_CUTOFF)
    df = df.withColumn("title", title).withColumn("title", F.coalesce("title", close))
    ranged = X.date_range_strict if strict_dates else X.date_range
    dates = X.bound(ranged(F.col("header")), lambda own: F.when(own["start"].isNotNull(), own).otherwise(ranged(F.col("body"))))
    df = df.withColumns({"company": X.company(F.col("header"), F.col("named")), "dates": dates, "points": X.bullets(F.col("body"))})
    sure = X.confidence(0.5, (F.col("company").isNotNull(), 0.2), (F.col("title").isNotNull(), 0.2), (F.col("dates.start").isNotNull() | F.col("dates.end").isNotNull(), 0.1), (F.size("points") > 0, 0.1))
    bullets = F.transform("points", lambda b: F.struct(b.alias("bullet_text"), X.metrics(b).alias("metrics"), X.skills(b).alias("skills_mentioned")))
    return df.select("doc_id", "sec_no", "block_no", F.col("header").alias("title_raw"), F.col("title").alias("title_norm"), F.col("company").alias("company_raw"), "dates.*", X.employment_type(F.col("title")).alias("employment_type"), sure.alias("extraction_confidence"), bullets.alias("bullets"))


def extract_education(sections: DataFrame, entities: DataFrame | None = None, systems: tuple[str, ...] = SYSTEMS, strict_dates: bool = False) -> DataFrame:
    """(doc_id, sec_no, block_no, …) of the blocks of education sections: degree, institution, grade, dates, confidence.
    The institution is the first organisation that the preferred system has found in the block."""
    own = sections.where("section_type = 'education'")
    n = parts(own, SECTIONS)
    own = _blocks(own, n).withColumn("to_", F.col("from_") + F.length("block"))
    own = _with_names(own, n, entities, systems, "from_", "to_").withColumn("block", X.collapse(F.col("block")))
    level = X.degree_level(F.col("block"))
    degree = F.when(F.lower("block").contains("dual degree"), F.lit("Dual Degree")).when(level == "masters", F.lit("M.Tech/M.E.")).when(level == "bachelors", F.lit("B.Tech/B.E."))
    d = (X.date_range_strict if strict_dates else X.date_range)(F.col("block"))
    sure = X.confidence(0.4, (F.col("named").isNotNull(), 0.2), (degree.isNotNull(), 0.1), (d["start"].isNotNull() | d["end"].isNotNull(), 0.1))
    return own.select("doc_id", "sec_no", "block_no", degree.alias("degree_raw"), level.alias("degree_level"), F.col("named").alias("institution_raw"), X.gpa(F.col("block")).alias("gpa"), d["start"].alias("start_date"), d["end"].alias("end_date"), sure.alias("extraction_confidence"))


def extract_skills(sections: DataFrame, entities: DataFrame | None = None, systems: tuple[str, ...] = ("hf",)) -> DataFrame:
    """(doc_id, sec_no, names): the listed skills that each skills section contains, and those that the systems have
    found there as MISC or LANGUAGE; sorted."""
    own = sections.where("section_type = 'skills'")
    n = parts(own, SECTIONS) if entities is not None else None
    own = own.select("doc_id", "sec_no", X.skills(F.coalesce("text", F.lit(""))).alias("_d"))
    if entities is None:
        return own.select("doc_id", "sec_no", F.col("_d").alias("names"))
    wanted = standing(entities, n).where(F.col("label").isin("MISC", "LANGUAGE") & F.col("system").isin(*systems) & F.lower("word").isin(*L.SKILLS))
    found = wanted.groupBy("doc_id", "sec_no").agg(F.collect_set(F.lower("word")).alias("_n"))
    nil = F.array().cast("array<string>")
    return own.join(found, ["doc_id", "sec_no"], "left").select("doc_id", "sec_no", F.sort_array(F.array_union("_d", F.coalesce("_n", nil))).alias("names"))


def extract_projects(sections: DataFrame) -> DataFrame:
    own = sections.where("section_type = 'projects'").select("doc_id", "sec_no", F.posexplode(X.project_blocks(F.col("text"))).alias("block_no", "block"))
    rows = X.lines(F.col("block"))
    url = F.get(X.urls(F.col("block")), F.lit(0))
    return own.where(F.size(rows) > 0).select("doc_id", "sec_no", "block_no", F.get(rows, F.lit(0)).alias("name"), F.nullif(F.array_join(F.slice(rows, 2, 10_000), " "), F.lit("")).alias("summary"), X.skills(F.col("block")).alias("tech_stack"), F.when(F.lower(url).contains("github"), url).alias("repo_url"), X.metrics(F.col("block")).alias("impact_metrics"))


def fan_out(records: DataFrame, key: str = "candidate_id", job: Column | None = None) -> dict[str, DataFrame]:
    """A DataFrame for each relational table. Dates become DATE after padding; blank lists give no rows."""
    date = lambda c: F.to_date(X.iso_date(F.col(c)))
    c = records.withColumn("c", F.col("candidate"))
    item = lambda name: records.select(key, F.explode(name).alias("_x")).select(key, "_x.*")
    achievements = F.trim(F.array_join(F.filter(F.coalesce("achievements", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != ""), " "))
    return {
        "candidate": c.select(key, F.col("c.full_name"), F.get("c.emails", F.lit(0)).alias("primary_email"), F.nullif(F.slice("c.emails", 2, 1000), F.array().cast("array<string>")).alias("alt_emails"), F.get("c.phones", F.lit(0)).alias("primary_phone"), F.col("c.location.city").alias("location_city"), F.col("c.location.state").alias("location_state"), F.col("c.location.country").alias("location_country"), F.col("c.links.linkedin").alias("linkedin_url"), F.col("c.links.github").alias("github_url"), F.lit(None).cast("string").alias("portfolio_url"), F.col("c.resume_text_hash"), F.col("c.source_file_id"), F.col("c.parsed_at"), (job if job is not None else F.lit(None).cast("string")).alias("job_id")),
        "resume_source": c.where("c.source_file_id is not null").select(F.col("c.source_file_id"), F.col("c.source_file_id").alias("filename")).distinct(),
        "experience": item("experience").withColumns({"start_date": date("start_date"), "end_date": date("end_date")}).drop("bullets", "extraction_confidence", "source_page"),
        "education": item("education").withColumns({"start_date": date("start_date"), "end_date": date("end_date")}).drop("extraction_confidence", "source_page"),
        "project": item("projects").withColumns({"start_date": date("start_date"), "end_date": date("end_date")}).withColumnRenamed("summary", "project_summary").drop("impact_metrics", "source_page"),
        "certification": item("certifications").withColumn("issue_date", date("issue_date")).withColumnRenamed("summary", "detailed_text"),
        "publication": item("publications"),
        "achievement": records.select(key, achievements.alias("description")).where("description <> ''"),
        "candidate_language": records.select(key, F.explode("languages").alias("_x")).select(key, F.col("_x.name").alias("language"), "_x.level"),
        "skill": records.select(key, F.sort_array(F.array_distinct(F.transform("skills", lambda s: F.lower(F.trim(s["name"]))))).alias("name_norm")).where(F.size("name_norm") > 0),
        "raw_section_text": records.select(key, F.col("candidate.source_file_id").alias("source_file_id"), F.explode("sectioned_text").alias("_x")).select(key, "source_file_id", "_x.section_type", "_x.text"),
    }


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], order: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """current with the latest incoming row (by `order`) of each key in place of its own; columns in keep_old fall back
    to the current value where the incoming one is null. A pure function: nothing is written."""
    last = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order))
    new = incoming.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    both = current.alias("o").join(new.alias("n"), key, "full_outer")
    fresh = F.col(f"n.{order}").isNotNull()
    cols = [c for c in current.columns if c not in key]
    pick = lambda c: F.when(fresh, F.coalesce(f"n.{c}", f"o.{c}") if c in keep_old else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*key, *[pick(c) if c in new.columns else F.col(f"o.{c}") for c in cols])


def append_children(current: DataFrame, incoming: DataFrame, once: bool = False) -> DataFrame:
    """Rows added; with `once` only rows that are not there yet (nulls being equal)."""
    return current.unionByName(incoming.exceptAll(current) if once else incoming, allowMissingColumns=True)


def move_stage(people: DataFrame, ids: list, source: str, target: str, key: str = "candidate_id", stage: str = "stage_of_process") -> tuple[DataFrame, DataFrame]:
    """(table after the move, rows that moved): only the listed rows that are in the source stage."""
    hit = F.col(key).isin(ids) & (F.col(stage) == source)
    moved = people.where(hit).withColumn(stage, F.lit(target))
    return people.withColumn(stage, F.when(hit, F.lit(target)).otherwise(F.col(stage))), moved


def set_scores(people: DataFrame, scores: DataFrame, key: str = "candidate_id") -> DataFrame:
    fresh = scores.select(key, F.col("job_score").alias("_s"))
    return people.join(fresh, key, "left").withColumn("job_score", F.coalesce("_s", "job_score")).drop("_s")


def job_score(sections: DataFrame) -> DataFrame:
    """(doc_id, job_score): weighted mean of section similarities (section_type, text, similarity) times 100, to two
    places; blank sections do not count, work experience counts as experience, unknown ones as other."""
    kind = F.when(F.col("section_type") == "work_experience", F.lit("experience")).when(F.col("section_type").isin(*L.SECTION_WEIGHTS), F.col("section_type")).otherwise(F.lit("other"))
    weight = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in L.SECTION_WEIGHTS.items()])
    used = sections.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_w", weight)
    return used.groupBy("doc_id").agg(F.round(100 * F.sum(F.col("_w") * F.col("similarity")) / F.sum("_w"), 2).alias("job_score"))


def candidate_list(people: DataFrame, job: str | None = None, stage: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """People by score, best first and nulls leading, as filtered by what is given."""
    for c, v in (("job_id", job), ("stage_of_process", stage)):
        if v:
            people = people.where(F.col(c) == v)
    return people.select(*(columns or people.columns)).orderBy(F.desc_nulls_first("job_score"))


def one_row(df: DataFrame):
    """The only row of df; an error for none or several."""
    rows = df.take(2)
    if len(rows) != 1:
        raise LookupError(f"expected one row, found {'none' if not rows else 'several'}")
    return rows[0]


def chunks_of_record(records: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Pieces for the vector store: (id, document, metadata) of summary-like sections, work, education and projects."""
    email = F.get("candidate.emails", F.lit(0))
    base = records.withColumns({"_e": email, "_n": F.col("candidate.full_name")})
    meta = lambda section, **more: F.map_filter(F.create_map(*[v for k, c in {"primary_email": F.col("_e"), "candidate_name": F.col("_n"), "section": F.lit(section), **more}.items() for v in (F.lit(k), c)]), lambda k, v: v.isNotNull())
    work = base.select(key, "_e", "_n", F.posexplode("experience").alias("pos", "x"))
    work = work.select(F.concat_ws("-", key, F.lit("experience"), "pos").alias("id"), F.concat_ws("\n", "x.title_raw", F.array_join(F.transform("x.bullets", lambda b: b["bullet_text"]), "\n")).alias("document"), meta("experience", title=F.col("x.title_norm"), skills_mentioned=F.to_json(F.array_distinct(F.flatten(F.transform("x.bullets", lambda b: b["skills_mentioned"]))))).alias("metadata"))
    made = base.select(key, "_e", "_n", F.posexplode("projects").alias("pos", "x"))
    made = made.select(F.concat_ws("-", key, F.lit("project"), "pos").alias("id"), F.concat_ws("\n", "x.name", "x.summary").alias("document"), meta("projects", tech_stack=F.to_json("x.tech_stack")).alias("metadata"))
    learnt = base.select(key, "_e", "_n", F.posexplode("education").alias("pos", "x"))
    learnt = learnt.select(F.concat_ws("-", key, F.lit("education"), "pos").alias("id"), F.concat_ws(", ", "x.degree_raw", "x.institution_raw").alias("document"), meta("education", degree_level=F.col("x.degree_level")).alias("metadata"))
    return work.unionByName(made).unionByName(learnt).where("document <> ''")
