"""Layout of positioned lines: column checks, bullets, education and title merges, glyphs, the rule-based sectioner."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions import fuzzy
from talentweave.functions import lexicon as L
from talentweave.functions import text as X
from talentweave.operators import sections as S
from talentweave.operators.folding import columns, fold
from talentweave.sources.scratch import written

_CUES = "|".join(L.ROLE_CUES)
_MONTH = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)[a-z]*\.?(?:\b|\s)"


def column_pages(lines: DataFrame, cuts: DataFrame, least_share: float = 0.3, least_width: float = 0.25, heavy: float = 0.2) -> DataFrame:
    """(doc_id, page, valid, right_heavy) of every page of lines: its cut, if it has one, leaves a fair share of lines and
    of width on either side."""
    df = lines.join(cuts, ["doc_id", "page"], "left").withColumn("_right", (F.col("x0") + F.col("x1")) / 2 > F.col("cut"))
    width = lambda side: F.max(F.when(side, F.col("x1"))) - F.min(F.when(side, F.col("x0")))
    right = F.sum(F.col("_right").cast("int")) / F.count(F.lit(1))
    g = df.groupBy("doc_id", "page").agg(right.alias("r"), width(F.col("_right")).alias("wr"), width(~F.col("_right")).alias("wl"))
    fair = (F.least("r", 1 - F.col("r")) >= least_share) & (F.greatest("wr", "wl") > 0) & (F.least("wr", "wl") >= least_width * F.greatest("wr", "wl"))
    valid = F.coalesce(fair, F.lit(False))
    return g.select("doc_id", "page", valid.alias("valid"), (valid & (F.col("r") >= heavy)).alias("right_heavy"))


def starts_bullet(x: Column) -> Column:
    return F.coalesce(F.ltrim(x).rlike(f"^[{re.escape(L.BULLET_GLYPHS)}]"), F.lit(False))


def looks_role_header(x: Column) -> Column:
    """Not lower-case at its start, and a month with a year, a company word, or a role word at its start."""
    t = F.trim(F.coalesce(x, F.lit("")))
    cue = (t.rlike(_MONTH) & t.rlike(r"\b(?:19|20)\d{2}\b")) | t.rlike(rf"(?i)\b(?:{'|'.join(L.COMPANY_CUES)})\b") | t.rlike(rf"^(?:{_CUES})\b")
    return (t != "") & ~t.rlike(r"^\p{Ll}") & cue


def _join_groups(df: DataFrame, fresh: Column, led: Column) -> DataFrame:
    """Runs of lines from each fresh one on; a run that a bullet leads becomes one line, others stay as they are."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    df = df.withColumn("_g", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(led).over(Window.partitionBy("doc_id", "_g").orderBy("line_no"))
    df = df.withColumn("_k", F.when(first, F.lit(-1)).otherwise(F.col("line_no")))
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("t"))))
    step = lambda a, p: F.when(a == "", p["t"]).when(a.endswith("-"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), p["t"])).otherwise(F.concat(a, F.lit(" "), p["t"]))
    text = F.aggregate(parts, F.lit(""), step)
    kept = [F.min(c).alias(c) for c in ("line_no", "page", "column", "x0", "y0") if c in df.columns] + [F.max(c).alias(c) for c in ("x1", "y1") if c in df.columns]
    return df.groupBy("doc_id", "_g", "_k").agg(*kept, F.regexp_replace(text, r"\s{2,}", " ").alias("text")).drop("_g", "_k")


def merge_bullet_lines(lines: DataFrame) -> DataFrame:
    """Lines behind a bullet continue it until a bullet, a bold or header-like line, or another page or column."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    moved = ~(F.col("page").eqNullSafe(F.lag("page").over(order)) & F.col("column").eqNullSafe(F.lag("column").over(order)))
    led = starts_bullet(F.col("text"))
    fresh = led | looks_role_header(F.col("text")) | F.coalesce("is_bold", F.lit(False)) | moved
    return _join_groups(lines.withColumns({"_f": fresh, "_b": led}), F.col("_f"), F.col("_b"))


def collapse_award_bullets(lines: DataFrame) -> DataFrame:
    """The second pass: inside an awards section, until another section starts, lines that begin like an award are
    bullets; then lines behind a bullet continue it as before."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.trim("text").rlike(L.AWARDS_HEADER), F.lit(True)).when(F.trim("text").rlike(L.SECTION_START), F.lit(False))
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(order), F.lit(False))
    award = F.col("_in") & F.trim("text").rlike(L.AWARD_START) & ~starts_bullet(F.col("text"))
    df = lines.withColumn("_in", inside).withColumn("text", F.when(award, F.concat(F.lit("• "), F.trim("text"))).otherwise(F.col("text")))
    led = starts_bullet(F.col("text"))
    fresh = led | looks_role_header(F.col("text")) | F.coalesce("is_bold", F.lit(False))
    return _join_groups(df.withColumns({"_f": fresh, "_b": led}), F.col("_f"), F.col("_b"))


def merge_education_and_titles(lines: DataFrame) -> DataFrame:
    """A degree takes the subject on the next line and then its institute; a lone level word takes the role behind it.
    Pieces share page and column; headers, bullets and bold lines are not taken. (doc_id, line_no, page, column, text)"""
    flagged = lines.select("doc_id", "line_no", "page", "column", F.trim("text").alias("text"), starts_bullet(F.col("text")).alias("bullet"), looks_role_header(F.col("text")).alias("header"), F.coalesce("is_bold", F.lit(False)).alias("bold"))
    degree, institute, title = (re.compile(p) for p in (L.DEGREE_START, L.INSTITUTE, L.TITLE_START))
    role, open_end = re.compile(rf"(?i)^(?:{_CUES})\b"), re.compile(r"(?i)\b(?:in|of)\.?$")

    def run(rows: list[dict]) -> list[dict]:
        out, i = [], 0
        while i < len(rows):
            row, taken = rows[i], 1
            place = row["page"], row["column"]
            after, third = (rows[i + k] if i + k < len(rows) and (rows[i + k]["page"], rows[i + k]["column"]) == place and not rows[i + k]["bullet"] else None for k in (1, 2))
            text = row["text"]
            if after and (degree.search(text) or open_end.search(text)) and not after["header"] and not after["bold"]:
                text, taken = f"{text} {after['text']}", 2
                if third and not third["header"] and institute.search(third["text"]):
                    text, taken = f"{text}, {third['text']}", 3
            elif after and title.search(text) and len(text.split()) <= 3 and role.search(after["text"]) and not after["bold"] and not after["header"]:
                text, taken = f"{text} {after['text']}", 2
            out.append({**{c: row[c] for c in ("doc_id", "line_no", "page", "column")}, "text": " ".join(text.split())})
            i += taken
        return out

    return fold(flagged, run, columns(flagged, "doc_id", "line_no", "page", "column", "text"))


def split_glued_roles(lines: DataFrame) -> DataFrame:
    """A line into which a role header runs is cut before it, if five characters stand on either side and the rest looks
    like a header; `part` numbers the pieces."""
    at = F.regexp_instr("text", F.lit(rf"(?i)\b(?:{_CUES})\b"))
    head, tail = F.rtrim(F.substring("text", F.lit(1), at - 1)), F.ltrim(F.substring("text", at, F.length("text")))
    cut = (at > 1) & (F.length(head) >= 5) & (F.length(tail) >= 5) & looks_role_header(tail)
    parts = F.when(cut, F.array(head, tail)).otherwise(F.array(F.col("text")))
    return lines.select(*[c for c in lines.columns if c != "text"], F.posexplode(parts).alias("part", "text"))


def plain_glyphs(x: Column) -> Column:
    """Compatibility forms, icon names as words, exotic bullets as one, spacing around colons and commas, no controls."""
    out = fuzzy.normal_form(x)
    for icon, word in L.ICONS.items():
        out = F.regexp_replace(out, rf"^[\\\s]*{icon}\b", word)
    out = F.regexp_replace(out, rf"^\s*[{L.EXOTIC_BULLETS}]+\s+", "• ")
    out = F.regexp_replace(out, r"(?i)^\s*z\s+(?=(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^\s*\*\s+(?=[A-Z][a-z]+, )", ""), "♂", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*:\s*", ": "), r"\s*,\s*", ", ")
    out = F.regexp_replace(out, r"(https?):\s*//", "$1://")
    return X.collapse(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " "))


def header_candidates(lines: DataFrame) -> DataFrame:
    """lines with `is_header`: a ruled line, or a short one that is bold, larger than its neighbourhood or in capitals."""
    df = S.sliding_median(lines, reach=10, out="_m")
    rule = F.col("text").rlike(r"[_\-–—]{4,}")
    short = F.length("text") <= 120
    return df.withColumn("is_header", rule | (short & X.looks_header(F.col("text"), F.col("is_bold"), F.col("font_size"), F.col("_m")))).drop("_m")


def fuzzy_header_label(lines: DataFrame, cutoff: float = L.HEADER_CUTOFF) -> DataFrame:
    """lines with `label`: the section whose header text is equal to or begins the line, in listed order, else the one
    closest by token-set ratio if that reaches the cutoff. Only header candidates get one."""
    entries = [(i, key, label) for i, (label, key) in enumerate((label, key) for label, keys in L.RULE_HEADERS for key in keys)]
    bare = F.trim(F.regexp_replace(F.lower(F.regexp_replace("text", r"[_\-–—:|•]+", " ")), r"[^a-z0-9\s]", ""))
    direct = F.coalesce(*[F.when(F.col("_t").startswith(key), F.lit(label)) for _, key, label in entries])
    texts = lines.where("is_header").select(bare.alias("_t")).where("_t <> ''").distinct().withColumn("_d", direct)
    near = fuzzy.closest(F.when(F.col("_d").isNull(), F.col("_t")), [key for _, key, _ in entries], fuzzy.token_set_ratio_of, cutoff, 1)
    names = F.array(*[F.lit(label) for _, _, label in entries])
    labels = written(texts.withColumn("_n", F.get(near, F.lit(0))["pos"]).select("_t", F.coalesce("_d", F.get(names, F.col("_n"))).alias("label")))
    return lines.withColumn("_t", F.when(F.col("is_header"), bare)).join(labels, "_t", "left").drop("_t")


def rule_sections(lines: DataFrame) -> DataFrame:
    """The sectioner by rules: noise out, wrapped lines joined, header candidates labelled, near repeats dropped, sections
    from each header to the next; skills that read like prose are "other", and so is a document without headers."""
    df = S.join_wrapped(header_candidates(S.without_noise(S.reading_order(lines))))
    df = df.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    # Written once, with what is needed: labels, headers and sections all read it.
    df = written(header_candidates(df.drop("is_header")).select("doc_id", "line_no", "page", "text", "is_header"))
    df = fuzzy_header_label(df)
    heads = S.dedupe_headers(df.where("label is not null").select("doc_id", "line_no", "label")).withColumnRenamed("label", "section_type")
    marked = df.join(heads, ["doc_id", "line_no"], "left").withColumn("_h", F.col("section_type").isNotNull())
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"sec_no": F.sum(F.col("_h").cast("int")).over(order), "section_type": F.last("section_type", ignorenulls=True).over(order), "_any": F.max("_h").over(Window.partitionBy("doc_id"))})
    body = marked.where(~F.col("_h") & (F.col("section_type").isNotNull() | ~F.col("_any"))).withColumn("section_type", F.coalesce("section_type", F.lit("other")))
    out = S.join_lines(body.withColumn("text", X.collapse(F.col("text"))), ["doc_id", "sec_no", "section_type"])
    own = X.lines(F.col("text"))
    prose = (F.aggregate(own, F.lit(0), lambda a, s: a + F.length(s)) > 60 * F.size(own)) & F.col("text").rlike(L.PROSE_VERBS)
    return out.withColumn("section_type", F.when((F.col("section_type") == "skills") & prose, F.lit("other")).otherwise(F.col("section_type")))


def best_titles(headers: DataFrame, header: str = "header", key: str = "id", cutoff: float = L.TITLE_CUTOFF) -> DataFrame:
    """(key, title): of the first piece of a header, between bars, commas, dashes and brackets, that comes close to a
    listed title, the closest title."""
    pieces = headers.select(key, F.posexplode(F.split(F.lower(header), r"[|,•\-–—@/()]")).alias("part", "piece")).withColumn("piece", F.trim("piece")).where("piece <> ''")
    best = F.get(fuzzy.closest(F.col("piece"), L.TITLES, fuzzy.token_set_ratio_of, cutoff, 1), F.lit(0))
    return pieces.withColumn("_b", best).where("_b is not null").groupBy(key).agg(F.min_by("_b.word", "part").alias("title"))
