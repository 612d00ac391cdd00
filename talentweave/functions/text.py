"""Text functions from column to column; all stay inside the JVM but the Unicode normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave.functions import lexicon as L


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once, however often `use` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def collapse(x: Column) -> Column:
    """Runs of white space (of any kind) become one space; trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def plain_norm(x: Column) -> Column:
    return F.lower(collapse(F.coalesce(x, F.lit(""))))


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def valid_phone(x: Column, reject_years: bool = False) -> Column:
    """8 to 15 digits; 8 or 9 only behind a plus sign; a range of years is none where asked."""
    n = F.length(digits(x))
    ok = n.between(8, 15) & (~n.isin(8, 9) | F.trim(x).startswith("+"))
    if reject_years:
        ok &= ~F.coalesce(x.rlike(L.YEAR_RANGE), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def normal_phone(x: Column, country: str | None = "IN") -> Column:
    d, plus = digits(x), F.trim(x).startswith("+")
    out = F.when(plus, F.concat(F.lit("+"), d)).otherwise(d)
    return F.when(~plus & (F.length(d) == 10), F.concat(F.lit("+91 "), d)).otherwise(out) if country == "IN" else out


def emails(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(L.EMAIL), F.lit(0))


def phones(x: Column, country: str | None = "IN") -> Column:
    """Valid phone numbers of a text, normalised, each once in order."""
    found = F.regexp_extract_all(x, F.lit(L.PHONE), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.transform(found, collapse), lambda p: valid_phone(p, True)), lambda p: normal_phone(p, country)))


def phones_as_written(x: Column) -> Column:
    """Phone numbers of a text as they stand there, each once; a range of years may be one."""
    found = F.transform(F.regexp_extract_all(x, F.lit(L.PHONE), F.lit(0)), collapse)
    return F.array_distinct(F.filter(found, lambda p: valid_phone(p)))


def urls(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(L.URL), F.lit(1))


def link(x: Column, pattern: str) -> Column:
    """The first profile link of a text, null without one; the pattern is L.LINKEDIN or L.GITHUB."""
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def unwrap_hyphens(x: Column) -> Column:
    """A hyphen between word characters goes, with white space after it."""
    return F.regexp_replace(x, r"(\w)-\s*(\w)", "$1$2")


def join_split_caps(x: Column) -> Column:
    """"S INGH" becomes "SINGH"."""
    return F.regexp_replace(x, r"\b([A-Z])\s+([A-Z]{2,})\b", "$1$2")


def join_spaced_caps(x: Column) -> Column:
    """Three or more single capitals, "A M A N", become "AMAN", then "S INGH" becomes "SINGH"."""
    return join_split_caps(F.regexp_replace(x, r"(?<=\b[A-Z] [A-Z]) (?=[A-Z]\b)|(?<=\b[A-Z]) (?=[A-Z] [A-Z]\b)", ""))


def person_name(x: Column, title_case: bool = True, spaced_caps: bool = True) -> Column:
    """A line as a name: without addresses, profile links and bars, single capitals joined; one in capitals gets title
    case, words of two letters excepted. spaced_caps=False joins a single capital to a word only, not to others."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, L.EMAIL, ""), L.LINKEDIN, ""), L.GITHUB, "")
    name = (join_spaced_caps if spaced_caps else join_split_caps)(collapse(F.regexp_replace(bare, r"\s+\|\s+", " ")))
    if not title_case:
        return name
    titled = lambda w: F.array_join(F.transform(F.split(w, r"(?<=\P{L})|(?=\P{L})"), lambda part: F.initcap(part)), "")
    words = F.transform(F.split(name, " "), lambda w: F.when(F.length(w) > 2, titled(w)).otherwise(w))
    return F.when(name.rlike(r"\p{Lu}") & ~name.rlike(r"\p{Ll}"), F.array_join(words, " ")).otherwise(name)


def all_caps(x: Column) -> Column:
    """At least 90 % of the letters are upper-case, and there is one."""
    # Runs of other characters go at once, instead of a match for each letter; without a capital letters are not counted.
    of = lambda kind: F.length(F.regexp_replace(x, rf"\P{{{kind}}}+", ""))
    return F.coalesce((of("Lu") > 0) & (of("Lu") >= 0.9 * of("L")), F.lit(False))


def looks_header(text: Column, bold: Column, size: Column, median: Column) -> Column:
    return F.coalesce(bold, F.lit(False)) | (F.coalesce(size, F.lit(0.0)) >= median + 0.8) | all_caps(text)


def header_text(x: Column) -> Column:
    """A line without trailing decoration, lower-cased, ready for the header lists."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"[:|•\-–—\s]+$", "")
    return F.trim(F.replace(F.replace(bare, F.lit("&amp;"), F.lit("&")), F.lit("  "), F.lit(" ")))


def header_label(x: Column) -> Column:
    """The section that a line opens: an exact header text, else the first listed one that it contains, else null."""
    entries = L.header_entries()
    text = header_text(x)
    exact = F.create_map(*[F.lit(v) for _, key, label in entries for v in (key, label)])
    inside = F.coalesce(*[F.when(F.contains(text, F.lit(key)), F.lit(label)) for _, key, label in entries])
    return F.coalesce(F.try_element_at(exact, text), inside)


def looks_header_line(x: Column) -> Column:
    """At most four words nearly all in capitals, or a line that ends in a rule."""
    t = F.trim(x)
    return (F.length(t) > 0) & (((F.size(F.split(t, r"\s+")) <= 4) & all_caps(t)) | t.rlike(r"[_\-]{4,}$"))


def lines(x: Column) -> Column:
    """Non-empty lines, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\r\n|\n|\r"), lambda s: F.trim(s)), lambda s: s != "")


def bullet(x: Column) -> Column:
    return F.ltrim(x).rlike("^[•\\-–—*]")


def bullet_or_dates(x: Column) -> Column:
    """A bullet in the first three lines or a range of years in the first five."""
    own = lines(x)
    return F.exists(F.slice(own, 1, 3), bullet) | F.exists(F.slice(own, 1, 5), lambda s: s.rlike(L.YEAR_RANGE))


def awards(x: Column) -> Column:
    own = lines(x)
    return F.coalesce(F.lower(x).rlike("award|honors|honours"), F.lit(False)) & (F.exists(own, bullet) | (F.size(own) >= 2))


def date_only(x: Column) -> Column:
    bare = F.regexp_replace(collapse(F.coalesce(x, F.lit(""))), r"(?i)^[*\-–—•z]\s*", "")
    return bare.rlike(L.YEAR_RANGE) & (F.size(lines(x)) == 1)


def skills(x: Column, vocabulary: list[str] | None = None) -> Column:
    """Dictionary entries that a text contains, as substrings, sorted; single letters but "r" are left out."""
    words = sorted(w for w in (vocabulary or L.SKILLS) if len(w) > 1 or w == "r")
    return F.filter(F.array(*map(F.lit, words)), lambda s: F.contains(F.lower(x), s))


def merge_skills(*lists: Column) -> Column:
    """Union of lists, lower-cased and trimmed, sorted; single letters but "r" are left out."""
    flat = F.transform(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), lambda s: F.lower(F.trim(s)))
    return F.sort_array(F.array_distinct(F.filter(flat, lambda s: (s != "") & ((F.length(s) > 1) | (s == "r")))))


def season_to_month(x: Column) -> Column:
    """"Spring '20" becomes "2020-03"; null without a season and a year."""
    low = F.lower(F.replace(x, F.lit("’"), F.lit("'")))
    month = F.coalesce(*[F.when(F.contains(low, F.lit(s)), F.lit(m)) for s, m in L.SEASONS])
    year = F.regexp_extract(low, r"'?(\d{2,4})", 1)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(year != "", F.concat(full, F.lit("-"), month))


def month_date(x: Column) -> Column:
    """"Aug 2023", "March, '22", "2024-05", "2024" or a season as YYYY-MM; null for anything else."""
    return bound(F.lower(F.trim(F.replace(x, F.lit("’"), F.lit("'")))), _month_of)


def _month_of(low: Column) -> Column:
    name = F.regexp_extract(low, r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s*'?(\d{4}|\d{2})$", 1)
    year = F.regexp_extract(low, r"'?(\d{4}|\d{2})$", 1)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    number = F.create_map(*[F.lit(v) for i, m in enumerate(L.MONTHS) for v in (m, f"{i + 1:02d}")])
    return (
        F.when(low.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.substring(low, 1, 7))
        .when(name != "", F.concat(full, F.lit("-"), F.try_element_at(number, name)))
        .when(low.rlike(r"^\d{4}$"), F.concat(low, F.lit("-01")))
        .otherwise(season_to_month(low))
    )


_MONTHLY = r"(?:Jan|Feb|Mar|Apr|May|Jun|July?|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?,?\s*['’]?\d{2,4}"
_WHEN = rf"{_MONTHLY}|\d{{4}}"
#: A date by itself; four digits of a longer number are no year.
_LONE = rf"(?i)({_MONTHLY}(?!\d)|(?<!\d)\d{{4}}(?!\d))"


def date_range(x: Column) -> Column:
    """struct(start, end, is_current) of the first range of a text, as YYYY-MM; a single date is both ends."""
    pattern = rf"(?i)\b({_WHEN})(?:\s*[-–—]\s*| to )({_WHEN}|present|current)\b"
    start, end = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)
    current = F.coalesce(x.rlike(r"(?i)\b(present|current)\b"), F.lit(False))
    before = F.regexp_extract(F.element_at(F.split(x, r"(?i)\b(?:present|current)\b"), 1), _LONE, 1)
    single = F.regexp_extract(x, _LONE, 1)
    return F.struct(
        F.when(current, month_date(before)).when(start != "", month_date(start)).otherwise(month_date(single)).alias("start"),
        F.when(current, F.lit(None).cast("string")).when(start != "", month_date(end)).otherwise(month_date(single)).alias("end"),
        current.alias("is_current"),
    )


_DAY = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s*,?\s*\d{4}|\d{4}"


def date_range_strict(x: Column) -> Column:
    """struct(start, end, is_current) of the first range of a text as YYYY-MM-DD, the first of the month; years have four
    digits, a single date is none, and a range may end in "present" or "current"."""
    pattern = rf"(?i)\b({_DAY})(?:\s*[-–—]\s*| to )({_DAY}|present|current)\b"
    tight = lambda i: F.regexp_replace(F.regexp_extract(x, pattern, i), r"\s*,\s*|\s+", " ")
    first = lambda d: F.when(d != "", F.concat(month_date(F.regexp_replace(d, r"(?i)^([a-z]+)(\d{4})$", "$1 $2")), F.lit("-01")))
    current = lambda d: F.coalesce(F.lower(d["end"]).isin("present", "current"), F.lit(False))
    made = lambda d: F.struct(first(d["start"]).alias("start"), F.when(~current(d), first(d["end"])).alias("end"), current(d).alias("is_current"))
    return bound(F.struct(tight(1).alias("start"), tight(2).alias("end")), made)


def iso_date(x: Column) -> Column:
    """YYYY-MM-DD as it is, YYYY-MM padded by -01, else null."""
    t = F.trim(x)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01")))


def metric(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).cast("int")


def metrics(x: Column) -> Column:
    """Percent, queries a second, 99th-percentile milliseconds and accuracy that a text states; absent ones left out."""
    found = {
        "percent": metric(x, r"(\d{1,3})\s*%"),
        "throughput_qps": metric(x, r"(?i)(\d{2,5})\s*qps"),
        "latency_p99_ms": metric(x, r"(?i)p99\s*[:=]?\s*(\d{1,5})\s*ms"),
        "accuracy_pct": metric(x, r"(?i)(\d{2,3})\s*%[^a-zA-Z]?(?:\s*accuracy|\bacc\b)"),
    }
    return F.map_filter(F.create_map(*[v for k, m in found.items() for v in (F.lit(k), m)]), lambda k, v: v.isNotNull())


def gpa(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"\b(\d+(?:\.\d+)?/(?:10|4))\b", 1), F.lit(""))


def degree_level(x: Column) -> Column:
    """Later rules win: masters over bachelors."""
    low = F.lower(x)
    return F.when(low.rlike(r"m\.tech|mtech|m\.e\.|m\.e "), F.lit("masters")).when(low.rlike(r"b\.tech|btech|b\.e\.|b\.e "), F.lit("bachelors"))


def languages(x: Column) -> Column:
    """array of struct(name, level) of the listed languages, with the level in brackets behind a name."""
    low = F.lower(x)
    each = [
        F.when(
            low.rlike(rf"\b{w}\b"),
            F.struct(F.lit(w.title()).alias("name"), F.nullif(F.regexp_extract(low, rf"\b{w}\b(?:\s*\(([^)]+)\))?", 1), F.lit("")).alias("level")),
        )
        for w in L.LANGUAGES
    ]
    return F.array_compact(F.array(*each))


def bullets(x: Column) -> Column:
    """Lines that start with a bullet stand alone without it; lines between them are joined by spaces."""
    step = lambda a, s: F.when(
        bullet(s), F.struct(F.concat(a["out"], F.array(F.regexp_replace(s, r"^[•\-–—* ]+", ""))).alias("out"), F.lit(False).alias("open"))
    ).otherwise(
        F.when(
            a["open"],
            F.struct(F.concat(F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(a["out"], -1), F.lit(" "), s))).alias("out"), F.lit(True).alias("open")),
        ).otherwise(F.struct(F.concat(a["out"], F.array(s)).alias("out"), F.lit(True).alias("open")))
    )
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))
    return F.filter(F.aggregate(lines(x), zero, step, lambda a: a["out"]), lambda s: F.trim(s) != "")


def blocks(x: Column) -> Column:
    return F.split(F.trim(x), r"\n{2,}")


def project_blocks(x: Column) -> Column:
    """A line in title case starts a new block."""
    return F.split(F.trim(x), r"(?m)\n(?=[A-Z][A-Za-z0-9 ()/&+\-]{2,}$)")


def company(header: Column, entity: Column | None = None) -> Column:
    """The recognised organisation, else what follows "at" or "@", else the last part between bars."""
    named = F.nullif(F.trim(F.regexp_extract(header, r"(?:at|@)\s+([A-Z][\w&.\- ]{2,})", 1)), F.lit(""))
    parts = F.filter(F.transform(F.split(header, "[|@]"), lambda p: F.trim(p)), lambda p: p != "")
    last = F.when(F.size(parts) >= 2, F.element_at(parts, -1))
    return F.coalesce(*([] if entity is None else [entity]), named, last)


def confidence(base: float, *steps: tuple[Column, float]) -> Column:
    """base and the additions whose condition holds, at most 1, to two places."""
    total = F.lit(base)
    for condition, more in steps:
        total = total + F.when(condition, F.lit(more)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), total), 2)


def employment_type(title: Column) -> Column:
    return F.when(F.contains(F.lower(title), F.lit("intern")), F.lit("internship"))


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the first ten hex digits of the SHA-1 of the parts, nulls being empty."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 10))


def document_hash(texts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(texts, "\n\n"), 256))


def first_filled(*xs: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def json_or_raw(x: Column) -> Column:
    """A JSON list of strings, else the text split at commas, bars, slashes and semicolons."""
    raw = F.filter(F.transform(F.split(x, r"[,/|;]"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.trim(x).startswith("["), F.coalesce(F.from_json(x, "array<string>"), raw)).otherwise(raw)


def requirements(x: Column) -> Column:
    return F.transform(F.split(x, ","), lambda s: F.trim(s))


def years_of_experience(x: Column) -> Column:
    return metric(x, r"(?i)(\d{1,2})\s*\+?\s*(?:years|yrs)")


def score_of(x: Column) -> Column:
    """The first number from 0 to 1 that an answer states."""
    return F.nullif(F.regexp_extract(x, r"([01](?:\.\d+)?)", 1), F.lit("")).cast("double")


def row_text(cells: Column) -> Column:
    """A table row between bars; nulls are empty."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))


def bullet_row(*named: tuple[str, Column]) -> Column:
    """- key: value, key: value of the filled columns."""
    return F.concat(F.lit("- "), F.concat_ws(", ", *[F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in named]))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def highlights(summary: Column, points: Column) -> Column:
    return F.filter(F.concat(F.array(summary), F.coalesce(points, F.array().cast("array<string>"))), lambda s: F.coalesce(s, F.lit("")) != "")


def categories(names: Column) -> Column:
    return F.create_map(F.lit("General"), F.sort_array(F.array_distinct(names)))


def glued_header(x: Column) -> Column:
    """A line in which a header in capitals is glued to what follows, as two parts."""
    keys = "|".join(sorted({k.upper() for _, k, _ in L.header_entries()}, key=lambda k: (-len(k), k)))
    return F.split(F.regexp_replace(x, rf"^({keys})(?=[A-Z][a-z])", "$1\n"), "\n")


def merge_wrapped_bullets(x: Column) -> Column:
    """A line break before a line that starts with a lower-case letter becomes a space."""
    return F.regexp_replace(x, r"\n(?=[a-z])", " ")


def compose_follow_up(previous: Column, question: Column) -> Column:
    return F.concat(F.lit("Previous question: "), previous, F.lit("\nFollow-up: "), question)


def minutes_later(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
