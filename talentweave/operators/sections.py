"""Positioned lines to labelled sections.

Lines are rows (doc_id, line_no, page, text, bbox fields, is_bold, font_size, column); order is always an explicit
column. What is a window computation stays one; only truly sequential folds go through a document's rows in pandas, and
a document bounds such a group.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions import lexicon as L
from talentweave.functions import text as X
from talentweave.operators.folding import columns, fold


def reading_order(df: DataFrame) -> DataFrame:
    """line_no by page, column, y and x."""
    order = Window.partitionBy("doc_id").orderBy("page", "column", "y0", "x0", "text")
    return df.withColumn("line_no", F.row_number().over(order))


def merge_columns(df: DataFrame) -> DataFrame:
    """Two columns of a page interleaved by y; the left one first at a tie."""
    order = Window.partitionBy("doc_id").orderBy("page", "y0", "column", "x0", "text")
    return df.withColumn("line_no", F.row_number().over(order))


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """Spans of a line joined in order: union of boxes, mean size, bold if at least half of them are."""
    parts = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    return spans.groupBy("doc_id", "page", "line_no").agg(
        X.collapse(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.round(F.avg("font_size"), 6).alias("font_size"),
        (F.sum(F.col("is_bold").cast("int")) >= F.greatest(F.lit(1), F.expr("count(*) div 2"))).alias("is_bold"),
    )


def without_noise(df: DataFrame) -> DataFrame:
    """Without empty lines, lone slashes and bars, and single bullet glyphs."""
    t = F.trim(F.coalesce("text", F.lit("")))
    return df.where((t != "") & ~t.isin("\\", "|", *L.BULLET_MARKS))


def sample_pages(df: DataFrame, first: int = 3, least_lines: int = 8) -> DataFrame:
    """The first pages and the last; pages with few lines are left out."""
    last = F.max("page").over(Window.partitionBy("doc_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page"))
    return df.withColumns({"_last": last, "_n": n}).where(((F.col("page") <= first) | (F.col("page") == F.col("_last"))) & (F.col("_n") >= least_lines)).drop("_last", "_n")


def column_cut(df: DataFrame, least_share: float = 0.33, strict: bool = False, at_left: bool = False, least_lines: int = 2) -> DataFrame:
    """(doc_id, page, cut): where the widest gap between sorted midpoints of lines lies, the first of equals, if it is at
    least this share of their range (more than it, if strict).

    The cut is the gap's middle, or its left end (at_left): a line at the cut belongs to the left column. The two-column
    reader takes the first form, the one-column reader strict=True, at_left=True, least_lines=6.
    """
    mid = df.select("doc_id", "page", ((F.col("x0") + F.col("x1")) / 2).alias("mid"))
    w = Window.partitionBy("doc_id", "page").orderBy("mid")
    gaps = mid.withColumn("next", F.lead("mid").over(w)).withColumn("gap", F.col("next") - F.col("mid"))
    cut = F.col("mid") if at_left else (F.col("mid") + F.col("next")) / 2
    best = gaps.groupBy("doc_id", "page").agg(F.max(F.struct("gap", (-F.col("mid")).alias("_m"), cut.alias("cut"))).alias("b"), (F.max("mid") - F.min("mid")).alias("span"), F.count(F.lit(1)).alias("n"))
    wide = F.col("b.gap") / F.col("span") > least_share if strict else F.col("b.gap") >= least_share * F.col("span")
    return best.where((F.col("b.gap") > 0) & wide & (F.col("n") >= least_lines)).select("doc_id", "page", F.col("b.cut").alias("cut"))


def two_means(df: DataFrame, rounds: int = 10, tolerance: float = 0.5, least_share: float = 0.2, least_ratio: float = 1.2) -> DataFrame:
    """(doc_id, page, low, high, cut): centres of a one-dimensional 2-means of line midpoints, from the outer quartiles
    by the exclusive method, and the cut midway between them.

    The rounds stop where both centres move less than `tolerance` or a cluster is empty. There is no cut, but null,
    where a page has fewer than two lines, a cluster is empty or has less than `least_share` of the lines, or the
    centres' distance is less than `least_ratio` times the sum of the clusters' standard deviations.
    """

    def quartile(v: list[float], p: float) -> float:
        if len(v) < 2:
            return v[0]
        j = min(max(int(p * (len(v) + 1)), 1), len(v) - 1)
        d = p * (len(v) + 1) - j
        return v[j - 1] * (1 - d) + v[j] * d

    def spread(v: list[float]) -> float:
        mean = sum(v) / len(v)
        return (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5

    def run(rows: list[dict]) -> list[dict]:
        out = []
        for page, group in groupby(rows, key=lambda r: r["page"]):
            mid = sorted((r["x0"] + r["x1"]) / 2 for r in group)
            sides = lambda low, high: ([m for m in mid if abs(m - low) <= abs(m - high)], [m for m in mid if abs(m - low) > abs(m - high)])
            low, high = quartile(mid, 0.25), quartile(mid, 0.75)
            for _ in range(rounds):
                a, b = sides(low, high)
                if not a or not b:
                    break
                before, (low, high) = (low, high), (sum(a) / len(a), sum(b) / len(b))
                if abs(low - before[0]) < tolerance and abs(high - before[1]) < tolerance:
                    break
            a, b = sides(low, high)
            apart = bool(a) and bool(b) and min(len(a), len(b)) / len(mid) >= least_share and abs(high - low) / (spread(a) + spread(b) + 1e-6) >= least_ratio
            out.append({"doc_id": rows[0]["doc_id"], "page": page, "low": float(low), "high": float(high), "cut": float((low + high) / 2) if apart else None})
        return out

    kept = df.select("doc_id", "page", "x0", "x1")
    return fold(kept, run, columns(kept, "doc_id", "page", low=T.DoubleType(), high=T.DoubleType(), cut=T.DoubleType()), ("page",))


def two_column_decision(pages: DataFrame) -> DataFrame:
    """(doc_id, layout, confidence) from pages (doc_id, page, valid, right_heavy): two columns if at least 60 % of the
    probed pages have a valid cut and one is heavy on the right."""
    share = F.avg(F.col("valid").cast("int"))
    two = (share >= 0.6) & F.max("right_heavy")
    return pages.groupBy("doc_id").agg(
        F.when(two, F.lit("two_column")).otherwise(F.lit("single")).alias("layout"),
        F.round(F.when(two, 0.5 + share / 2).otherwise(0.75 - share / 4), 4).alias("confidence"),
        F.sum(F.col("valid").cast("int")).alias("cuts_found"),
        F.count(F.lit(1)).alias("pages"),
    )


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles by the exclusive method: the value at p * (n + 1), interpolated."""
    v = F.array_sort(F.collect_list(F.col(value).cast("double")))
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(v.alias("_v"))
    def q(p: float) -> Column:
        n = F.size("_v")
        j = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(p) * (n + 1)).cast("int")))
        d = F.lit(p) * (n + 1) - j
        return F.when(n < 2, F.get("_v", F.lit(0))).otherwise(F.get("_v", j - 1) * (1 - d) + F.get("_v", j) * d)
    return out.select(*by, *[F.round(q(p), 6).alias(f"q{int(p * 4)}") for p in (0.25, 0.5, 0.75)])


def bands(df: DataFrame, height: float = 3.0) -> DataFrame:
    """line_no: the band of each line (greedy). In reading order, by page, column, top and left edge, every line that no
    band has yet opens one and takes all later lines of its page whose top is less than `height` above or below its own.
    Without a column all lines are in one."""

    def run(rows: list[dict]) -> list[dict]:
        band = 0
        for _, group in groupby(rows, key=lambda r: r["page"]):
            page = list(group)
            tops = sorted((r["y0"], i) for i, r in enumerate(page))
            for row in page:
                if row["line_no"] is None:
                    band += 1
                    for _, i in tops[bisect_left(tops, (row["y0"] - height, -1)) : bisect_left(tops, (row["y0"] + height, -1))]:
                        if page[i]["line_no"] is None and abs(page[i]["y0"] - row["y0"]) < height:
                            page[i]["line_no"] = band
        return rows

    kept = df.select("doc_id", "page", F.col("column") if "column" in df.columns else F.lit(0).alias("column"), "x0", "y0", "text", F.lit(None).cast("int").alias("line_no"))
    return fold(kept, run, columns(kept, *kept.columns), ("page", "column", "y0", "x0", "text"))


def sliding_median(df: DataFrame, value: str = "font_size", reach: int = 5, by: str = "doc_id", order: str = "line_no", out: str = "median") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn(out, F.percentile(F.col(value), F.lit(0.5)).over(w))


def fill_down(df: DataFrame, label: str, by: str = "doc_id", order: str = "line_no", out: str = "section") -> DataFrame:
    """The last label so far, for every row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(label, ignorenulls=True).over(w))


def islands(df: DataFrame, label: str, by: str = "doc_id", order: str = "line_no", out: str = "island") -> DataFrame:
    """The number of each run of equal labels, from 1."""
    w = Window.partitionBy(by).orderBy(order)
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_c", change).withColumn(out, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def sections_from_headers(lines: DataFrame, reference: bool = True) -> DataFrame:
    """Lines grouped under the last header line above them: (doc_id, sec_no, section_type, text, first_page, last_page).

    Header lines and lines before the first header are left out (reference mode), else the latter form an "other"
    section.
    """
    df = lines.withColumn("text", X.collapse(F.coalesce("text", F.lit("")))).where("text <> ''").withColumn("_h", X.header_label(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    df = df.withColumn("sec_no", F.sum(F.col("_h").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = fill_down(df, "_h", out="section_type").where(F.col("_h").isNull())
    df = df.where("section_type is not null") if reference else df.withColumn("section_type", F.coalesce("section_type", F.lit("other")))
    return join_lines(df, ["doc_id", "sec_no", "section_type"])


def join_lines(df: DataFrame, by: list[str], separator: str = "\n") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return df.groupBy(*by).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"), F.min("page").alias("first_page"), F.max("page").alias("last_page")
    )


def sections_from_labels(lines: DataFrame, label: str = "label") -> DataFrame:
    """Runs of lines with one label; single glyphs are left out, empty sections dropped, equal neighbours merged."""
    df = islands(lines.withColumn("text", X.collapse(F.coalesce("text", F.lit("")))), label)
    df = df.where((F.col("text") != "") & ~F.col("text").isin(*L.BULLET_MARKS))
    joined = join_lines(df.withColumn("section_type", F.col(label)), ["doc_id", "island", "section_type"]).withColumnRenamed("island", "sec_no")
    return merge_adjacent(joined)


def merge_adjacent(sections: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Neighbouring sections of one type become one. skip_empty: an empty text adds no line."""
    df = islands(sections, "section_type", order="sec_no").withColumnRenamed("sec_no", "line_no")
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "text")) if skip_empty else F.struct("line_no", "text")))
    return df.groupBy("doc_id", "island", "section_type").agg(
        F.btrim(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), F.lit(" \t\r\n")).alias("text"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page")
    ).withColumnRenamed("island", "sec_no")


def low_confidence_to_other(df: DataFrame, least: float = L.LEAST_CONFIDENCE) -> DataFrame:
    """Labels of a model (label, score) as they are, "other" below the least confidence."""
    return df.withColumn("label", F.when(F.col("score") >= least, F.col("label")).otherwise(F.lit("other")))


def majority_label(df: DataFrame, reach: int = 2, below: float = L.LEAST_CONFIDENCE) -> DataFrame:
    """A label with a low score becomes the most frequent of its neighbourhood; ties go to the nearest, then by name."""
    near = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-reach, reach)
    df = df.withColumn("_near", F.collect_list(F.struct("line_no", "label")).over(near))
    ranked = F.transform(
        F.array_distinct(F.transform("_near", lambda s: s["label"])),
        lambda c: F.struct(
            (-F.size(F.filter("_near", lambda s: s["label"] == c))).alias("n"),
            F.array_min(F.transform(F.filter("_near", lambda s: s["label"] == c), lambda s: F.abs(s["line_no"] - F.col("line_no")))).alias("far"),
            c.alias("label"),
        ),
    )
    return df.withColumn("label", F.when(F.col("score") < below, F.get(F.array_sort(ranked), F.lit(0))["label"]).otherwise(F.col("label"))).drop("_near")


def absorb_other(sections: DataFrame) -> DataFrame:
    """A run of "other" between two labelled sections takes the label on its left if it looks like a body."""
    df = islands(sections.withColumn("_o", F.col("section_type") == "other"), "_o", order="sec_no", out="_run")
    order = Window.partitionBy("doc_id").orderBy("sec_no")
    before = F.last(F.when(~F.col("_o"), F.col("section_type")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(~F.col("_o"), F.col("section_type")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    body = F.max(X.bullet_or_dates(F.col("text")) | (F.size(X.lines(F.col("text"))) >= 2)).over(Window.partitionBy("doc_id", "_run"))
    df = df.withColumns({"_l": before, "_r": after, "_b": body})
    take = F.col("_o") & F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_b")
    return df.withColumn("section_type", F.when(take, F.col("_l")).otherwise(F.col("section_type"))).drop("_o", "_run", "_l", "_r", "_b")


def relabel_after_strong(sections: DataFrame, test=X.bullet_or_dates, strong: tuple[str, ...] = ("work_experience", "projects", "education", "internships")) -> DataFrame:
    """A chain of "other" sections that pass the test takes the label of the strong section it follows."""
    eligible = (F.col("section_type") == "other") & test(F.col("text"))
    df = sections.withColumn("_e", eligible)
    order = Window.partitionBy("doc_id").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("_e"), F.col("section_type")), ignorenulls=True).over(order)
    df = df.withColumn("_l", last)
    return df.withColumn("section_type", F.when(F.col("_e") & F.col("_l").isin(*strong), F.col("_l")).otherwise(F.col("section_type"))).drop("_e", "_l")


def retype_awards(sections: DataFrame) -> DataFrame:
    hit = F.col("section_type").isin("responsibility", "other") & X.awards(F.col("text"))
    return sections.withColumn("section_type", F.when(hit, F.lit("achievements")).otherwise(F.col("section_type")))


def relabel_headers(sections: DataFrame) -> DataFrame:
    """A section that is one header-like line takes the label that its text names."""
    own = X.lines(F.col("text"))
    one = (F.size(own) == 1) & X.looks_header_line(F.get(own, F.lit(0)))
    return sections.withColumn("section_type", F.when(one, F.coalesce(X.header_label(F.get(own, F.lit(0))), F.col("section_type"))).otherwise(F.col("section_type")))


def collapse_headers(sections: DataFrame) -> DataFrame:
    """A header-only section hands its label to the next one, if that is "other", and goes. The next one is consumed: it
    opens nothing itself, so in a run of header-only sections every other one goes, and the last of a document stays."""
    own = X.lines(F.col("text"))
    order = Window.partitionBy("doc_id").orderBy("sec_no")
    head = F.coalesce((F.size(own) == 1) & X.looks_header_line(F.get(own, F.lit(0))), F.lit(False))
    df = sections.withColumn("_h", head).withColumns({"_run": F.sum((~F.col("_h")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_more": F.lead(F.lit(True)).over(order)})
    # In a run a section that is no header comes first, except at a document's start, where none has number 0.
    place = F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("sec_no")) - F.when(F.col("_run") > 0, 1).otherwise(0)
    df = df.withColumn("_open", F.col("_h") & (place % 2 == 1) & F.col("_more").isNotNull())
    df = df.withColumn("_from", F.when(F.lag("_open").over(order), F.lag("section_type").over(order)))
    adopt = (F.col("section_type") == "other") & F.col("_from").isNotNull()
    return df.withColumn("section_type", F.when(adopt, F.col("_from")).otherwise(F.col("section_type"))).where(~F.col("_open")).drop("_h", "_run", "_more", "_open", "_from")


def split_inline_headers(sections: DataFrame) -> DataFrame:
    """A section of several lines is cut at the first line that names a label: what stands above keeps its type, the rest,
    that line included, takes the label. Sections are numbered anew."""
    own = X.lines(F.col("text"))
    keys = "|".join(re.escape(key) for _, key, _ in L.header_entries())
    names = F.array_position(F.transform(own, lambda s: F.coalesce(X.header_text(s).rlike(keys), F.lit(False))), True)
    df = sections.withColumns({"_lines": own, "_at": F.when(F.size(own) > 1, names).otherwise(F.lit(0))})
    piece = lambda kind, a, n, no: F.struct(F.lit(no).alias("no"), kind.alias("kind"), F.array_join(F.slice("_lines", a, n), "\n").alias("body"))
    whole = F.struct(F.lit(0).alias("no"), F.col("section_type").alias("kind"), F.col("text").alias("body"))
    label = X.header_label(F.get("_lines", F.greatest(F.col("_at") - 1, F.lit(0)).cast("int")))
    at = F.col("_at").cast("int")
    cut = F.array(piece(F.col("section_type"), F.lit(1), F.greatest(at - 1, F.lit(0)), 0), piece(label, F.greatest(at, F.lit(1)), F.size("_lines"), 1))
    parts = df.withColumn("_p", F.explode(F.when(at > 0, F.filter(cut, lambda p: p["body"] != "")).otherwise(F.array(whole))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_no", "_p.no")).cast("long")
    return parts.select("doc_id", number.alias("sec_no"), F.col("_p.kind").alias("section_type"), F.col("_p.body").alias("text"), "first_page", "last_page")


def guard_names(sections: DataFrame, candidates: DataFrame) -> DataFrame:
    """A first section that is one line of the candidate's name, or of a part of it, and was labelled as patents,
    publications or other becomes a summary. candidates: (doc_id, full_name), a row a document at most."""
    tight = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    names = candidates.select("doc_id", tight(F.col("full_name")).alias("_name")).where("_name <> ''")
    df = sections.join(names, "doc_id", "left").withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_no")))
    own = X.lines(F.col("text"))
    line = tight(F.get(own, F.lit(0)))
    named = F.contains(F.col("_name"), line) | F.contains(line, F.col("_name"))
    hit = (F.col("_r") == 1) & (F.size(own) == 1) & named & F.col("section_type").isin("patents", "publications", "other")
    return df.withColumn("section_type", F.when(hit, F.lit("summary")).otherwise(F.col("section_type"))).select(sections.columns)


_CONTACT = "array<struct<kind: string, value: string, pos: int>>"
#: Kinds of which a candidate has one; of the others a list.
ONE_OF = ("linkedin", "github")


def _found(text: Column) -> Column:
    """The contacts of a line in the order in which they are looked for."""
    many = lambda kind, values: F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("pos")))
    one = lambda kind, value: F.filter(F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(0).alias("pos"))), lambda s: s["value"].isNotNull())
    return F.concat(many("email", X.emails(text)), many("phone", X.phones(text)), one("linkedin", X.link(text, L.LINKEDIN)), one("github", X.link(text, L.GITHUB)), many("url", X.urls(text))).cast(_CONTACT)


def promote_contacts(sections: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, candidates): lines that add a contact to the candidate go from the sections, and their contacts join it.

    A line goes only if it has an address, phone or URL that neither the candidate nor an earlier line of the document
    had, or the first profile link of a kind that the candidate lacks. candidates: (doc_id, full_name, emails, phones,
    linkedin, github), a row a document at most; they come back with links_other and with documents they lacked. A
    null text counts as empty; every section stays, even if nothing is left of its text.
    """
    spark = sections.sparkSession
    key = sections.schema["doc_id"].dataType.simpleString()
    if candidates is None:
        candidates = spark.createDataFrame([], f"doc_id {key}, full_name string, emails array<string>, phones array<string>, linkedin string, github string")
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r"))
    lines = sections.select("doc_id", "sec_no", split.alias("line_no", "line"))
    # The first line of each document, kind and value; of profile links the first of each kind.
    values = lines.select("doc_id", "sec_no", "line_no", F.explode(_found(F.col("line"))).alias("c")).select("doc_id", "sec_no", "line_no", "c.*")
    slot = F.when(F.col("kind").isin(*ONE_OF), F.lit("")).otherwise(F.col("value"))
    first = values.groupBy("doc_id", "kind", slot.alias("slot")).agg(F.min(F.struct("sec_no", "line_no", "pos", "value")).alias("at"))
    nil = F.array().cast("array<string>")
    have = candidates.select("doc_id", *[F.coalesce(c, nil).alias(f"_{c}") for c in ("emails", "phones")], *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in ONE_OF])
    known = F.coalesce(
        ((F.col("kind") == "email") & F.array_contains("_emails", F.col("slot"))) | ((F.col("kind") == "phone") & F.array_contains("_phones", F.col("slot")))
        | ((F.col("kind") == "linkedin") & F.col("_linkedin").isNotNull()) | ((F.col("kind") == "github") & F.col("_github").isNotNull()), F.lit(False))
    new = first.join(have, "doc_id", "left").where(~known).select("doc_id", "kind", "at")
    gone = new.select("doc_id", "at.sec_no", "at.line_no").distinct().withColumn("_gone", F.lit(True))
    parts = F.array_sort(F.collect_list(F.when(F.col("_gone").isNull(), F.struct("line_no", "line"))))
    text = F.btrim(F.array_join(F.transform(parts, lambda p: p["line"]), "\n"), F.lit(" \t\r\n"))
    kept = lines.join(gone, ["doc_id", "sec_no", "line_no"], "left").groupBy("doc_id", "sec_no").agg(text.alias("text"))
    stripped = sections.drop("text").join(kept, ["doc_id", "sec_no"]).select(sections.columns)
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("at")))), lambda s: s["value"])
    added = new.groupBy("doc_id").agg(of("email").alias("_e"), of("phone").alias("_p"), of("url").alias("links_other"), *[F.get(of(k), F.lit(0)).alias(f"_{k}") for k in ONE_OF])
    grown = candidates.join(added, "doc_id", "full").select(
        "doc_id", "full_name", *[F.concat(F.coalesce(c, nil), F.coalesce(a, nil)).alias(c) for c, a in (("emails", "_e"), ("phones", "_p"))],
        *[F.coalesce(F.nullif(F.col(k), F.lit("")), F.col(f"_{k}")).alias(k) for k in ONE_OF], F.coalesce("links_other", nil).alias("links_other"),
    )
    return stripped, grown


def drop_empty(sections: DataFrame) -> DataFrame:
    return sections.where(F.size(X.lines(F.col("text"))) > 0)


def post_process_all(sections: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, candidates) after the whole chain, in its fixed order; see promote_contacts for the candidates."""
    df = relabel_after_strong(relabel_headers(sections))
    df = split_inline_headers(collapse_headers(df))
    df = absorb_other(relabel_after_strong(retype_awards(df), X.date_only))
    if candidates is not None:
        df = guard_names(df, candidates)
    df, grown = promote_contacts(df, candidates)
    return drop_empty(merge_adjacent(df, skip_empty=True)), grown


def post_process(sections: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """The sections (doc_id, sec_no, section_type, text, first_page, last_page) after the whole chain."""
    return post_process_all(sections, candidates)[0]


def contacts(lines: DataFrame, top: int = 12, normalise: bool = True, title_case: bool = True, spaced_caps: bool = True) -> DataFrame:
    """(doc_id, full_name, emails, phones, linkedin, github) of every document.

    Contacts are those of the first `top` lines of page one, of profile links the last one there. A kind that is missing
    there is taken from the first line of the document that has it; profile links only where addresses, phones or both
    links are missing on top. The name is the largest of the first five lines of page one, the first of equals; a line
    without a size counts with the median of the five. normalise=False and title_case=False leave phones and names as
    they are written, spaced_caps=False leaves runs of single capitals.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    place = F.when(F.col("page") == 1, F.sum(F.when(F.col("page") == 1, 1).otherwise(0)).over(order))
    text = F.coalesce("text", F.lit(""))
    size = F.col("font_size") if "font_size" in lines.columns else F.lit(None)
    found = {"e": X.emails(text), "p": X.phones(text, "IN") if normalise else X.phones_as_written(text), "li": X.link(text, L.LINKEDIN), "gh": X.link(text, L.GITHUB)}
    df = lines.select("doc_id", "line_no", place.alias("_r"), text.alias("text"), size.cast("double").alias("size"), *[v.alias(k) for k, v in found.items()])
    on_top = F.coalesce(F.col("_r") <= top, F.lit(False))
    lists = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(on_top & (F.size(c) > 0), F.struct("line_no", c)))), lambda s: s[c])))
    first = lambda c, some: F.min(F.when(some, F.struct("line_no", c)))[c]
    got = df.groupBy("doc_id").agg(
        *[lists(c).alias(f"t{c}") for c in ("e", "p")], *[F.array_distinct(first(c, F.size(c) > 0)).alias(f"a{c}") for c in ("e", "p")],
        *[F.max(F.when(on_top & F.col(c).isNotNull(), F.struct("line_no", c)))[c].alias(f"t{c}") for c in ("li", "gh")], *[first(c, F.col(c).isNotNull()).alias(f"a{c}") for c in ("li", "gh")],
        F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.struct("_r", "size", "text")))).alias("five"),
    )
    sizes = F.array_sort(F.transform(F.filter("five", lambda s: s["size"].isNotNull()), lambda s: s["size"]))
    n = F.size(sizes)
    median = F.coalesce((F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2, F.lit(0.0))
    ranked = F.transform("five", lambda s: F.struct(F.when(F.coalesce(s["size"], F.lit(0.0)) == 0, F.col("_m")).otherwise(s["size"]).alias("size"), (-s["_r"]).alias("_r"), s["text"].alias("text")))
    nil = F.array().cast("array<string>")
    lacking = (F.size("te") == 0) | (F.size("tp") == 0) | (F.col("tli").isNull() & F.col("tgh").isNull())
    return got.withColumn("_m", median).select(
        "doc_id", X.person_name(F.array_max(ranked)["text"], title_case, spaced_caps).alias("full_name"),
        *[F.when(F.size(f"t{c}") > 0, F.col(f"t{c}")).otherwise(F.coalesce(f"a{c}", nil)).alias(k) for k, c in (("emails", "e"), ("phones", "p"))],
        *[F.coalesce(f"t{c}", F.when(lacking, F.col(f"a{c}"))).alias(k) for k, c in (("linkedin", "li"), ("github", "gh"))],
    )


def candidate_name(lines: DataFrame, spaced_caps: bool = True) -> DataFrame:
    """(doc_id, full_name) as contacts() finds it, of documents with a first page."""
    return contacts(lines.where("page = 1"), spaced_caps=spaced_caps).select("doc_id", "full_name")


def dedupe_headers(headers: DataFrame, near: int = 2) -> DataFrame:
    """Headers (doc_id, line_no, label) without those within `near` lines of the last kept one, if it has their label."""

    def run(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for row in rows:
            if not kept or row["label"] != kept[-1]["label"] or row["line_no"] - kept[-1]["line_no"] > near:
                kept.append(row)
        return kept

    return fold(headers, run, headers.schema)


def header_spans(headers: DataFrame) -> DataFrame:
    """Each header with the line before the next one, null at the end."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return headers.withColumn("last_line", F.lead("line_no").over(w) - 1)


def join_wrapped(lines: DataFrame, gap: float = 3.5, indent: float = 4.0) -> DataFrame:
    """Lines of a page whose top is within `gap` of the bottom above and whose indent within `indent` of the first's
    become one; the box grows with each. Bullets start anew, and lines marked is_header, where there is such a column,
    stay alone."""

    heads = "is_header" in lines.columns
    bullet = re.compile("[•\\-–—*]")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last line so far, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            # Columns are handled as they are: rows pass by number, only texts and boxes are looked at.
            b = b if held is None else pa.concat_batches([held, b])
            of = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            docs, pages, texts, x0, y0, x1, y1 = map(of, ("doc_id", "page", "text", "x0", "y0", "x1", "y1"))
            alone = of("is_header") if heads else [False] * len(docs)
            kept, parts = [], []
            for i, text in enumerate(texts):
                p = kept[-1] if kept else None
                if p is not None and docs[p] == docs[i] and not alone[i] and not alone[p] and pages[p] == pages[i] and y0[i] - y1[p] <= gap and abs(x0[i] - x0[p]) <= indent and not bullet.match(text.lstrip()):
                    parts[-1].append(text)
                    y1[p], x1[p] = max(y1[p], y1[i]), max(x1[p], x1[i])
                else:
                    kept.append(i)
                    parts.append([text])
            new = {"text": [" ".join(t) for t in parts], "x1": [x1[i] for i in kept], "y1": [y1[i] for i in kept]}
            out = b.take(pa.array(kept, pa.int64()))
            out = pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else out.column(f.name) for f in out.schema], schema=out.schema)
            yield out.slice(0, out.num_rows - 1)
            held = out.slice(out.num_rows - 1)
        if held is not None:
            yield held

    return lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_no", "y0", "x0", "text").mapInArrow(work, lines.schema)


def merge_bullets(lines: DataFrame) -> DataFrame:
    """A line that starts with neither a bullet, a capital nor a digit continues the one before it."""
    fresh = F.ltrim("text").rlike(r"^(?:[•●◦▪·\-–—*]|\p{Lu}|\d)")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    df = lines.withColumn("_n", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("t"))))
    return df.groupBy("doc_id", "_n").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text")).drop("_n")


def suppress_flips(lines: DataFrame, below: float = 0.55) -> DataFrame:
    """A single line whose neighbours agree takes their label, the one above as already smoothed.

    A line that has been changed has the label of the one below it, which then has no reason to change. So in a run of
    lines that differ from two agreeing neighbours every other one changes, from the first.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    above, under = F.lag("label").over(order), F.lead("label").over(order)
    odd = F.coalesce((F.col("label") != above) & (above == under) & (F.col("score") < below), F.lit(False))
    df = lines.withColumns({"_odd": odd, "_above": above}).withColumn("_run", F.sum((~F.col("_odd")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A run's number is that of the line before it, which is none of it; a first line never differs from two neighbours.
    place = F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("line_no"))
    return df.withColumn("label", F.when(F.col("_odd") & (place % 2 == 0), F.col("_above")).otherwise(F.col("label"))).select(lines.columns)
