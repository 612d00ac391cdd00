"""Rows that the small test tables lack: queries on tables of their own give what their DuckDB counterparts give."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.test_queries import plain

from talentweave.functions import fuzzy
from talentweave.functions import text as X
from talentweave.operators import dealing, evaluation, gramjoin, layout, matching, people, retrieval, sections
from talentweave.plans import registry


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over the given tables, name=(rows, schema), equals its counterpart; the rows it gives."""

    def run(query, **tables):
        duck = duckdb.connect()
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
            duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        df = registry.queries()[query](spark, str(tmp_path))
        got = sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())
        want = duck.sql(f"select {', '.join(sorted(df.columns))} from ({registry.oracle_sql()[query]})").fetchall()
        assert got == sorted(tuple(map(plain, r)) for r in want)
        return df.collect()

    return run


def test_names_of_single_capitals_equal_the_counterpart(same):
    texts = ["A A A A that, that\nb", "of. of. Y Y Y Y", "J O N S INGH\nx", "S INGH | A B C", "plain name"]
    got = same("candidate_names", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.full_name for r in got} >= {"A A A A that, that", "J O N Singh"}


def test_numbers_of_more_digits_are_no_years(same):
    got = same("education_entities", supplier=([(k,) for k in (7, 999, 1000, 9999, 10000, 20190, 123456)], "s_suppkey long"))
    assert {r.start_date for r in got if r.doc_id > 9999} == {"2001-01", None}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_stay_in_a_row(spark):
    assert "Exchange" not in _plan(retrieval.variants(spark.createDataFrame([(1, "sql developer")], "id int, question string")))


def test_partitions_follow_the_rows(spark, monkeypatch):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert dealing.parts(df) is None and dealing.parts(df, 100) == 10
    assert dealing.dealt(df, 10, "k").rdd.getNumPartitions() == 10
    monkeypatch.setattr(people, "SECTIONS", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    work = df.selectExpr("k as doc_id", "1 as sec_no", "'education' as section_type", "'M.Tech at Some School\n\nB.Tech' as text")
    found = df.selectExpr("k as doc_id", "1 as sec_no", "'hf' as system", "'ORG' as label", "'Some School' as word", "10 as start", "21 as end", "0.5D as score")
    try:
        out = people.extract_education(work, found)
        # Sections and entities meet where they were dealt to.
        assert [x for x in _plan(out).splitlines() if "Exchange" in x and "REPARTITION_BY_NUM" not in x] == []
        assert out.rdd.getNumPartitions() == 50
        assert {(r.block_no, r.institution_raw) for r in out.collect()} == {(0, "Some School"), (1, None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_items_go_before_they_are_normalised(spark):
    rows = [("e", "f", s, i) for s, i in (("a", " X  y"), ("a", "x y"), ("a", "x y"), ("b", "X Y"), ("b", None))]
    of = evaluation.holders(spark.createDataFrame(rows, "entity string, field string, system string, item string"))
    assert _plan(of).count("Exchange hashpartitioning") == 2
    assert {(r["item"], *r.systems) for r in of.collect()} == {("x y", "a", "b"), (None, "b")}


def test_spelling_aligns_few_pairs_and_each_once(spark):
    rng = random.Random(4)
    some = {"".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(400)} | {"aabbaabb", "abcd", "badc", "abcde", "bacdf"}
    terms, words = set(sorted(some)[::4]) | {"badc", "bacdf"}, some | {"aaabbb"}
    near = {w: min(((fuzzy.alignment_of(w, t), t) for t in terms)) for w in words}
    df = matching.spell(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t, 1) for t in terms], "term string, freq int"))
    assert dict(map(tuple, df.collect())) == {w: t if d <= 2 else w for w, (d, t) in near.items()}
    text = _plan(df)
    assert text.split("== Initial Plan ==")[-1].count("ArrowEvalPython") == 1 and "Join" in text
    assert not any("levenshtein" in x for x in text.splitlines() if "Join" in x)


def test_names_are_read_once_and_pairs_scored_once(spark, tmp_path):
    spark.createDataFrame([(f"custmer{i}", f"a{i}@x") for i in range(50)], "full_name string, email string").write.parquet(f"{tmp_path}/people")
    tokens = spark.createDataFrame([(0, "customer7"), (1, "custmer12")], "pos int, token string")
    df = matching.fuzzy_names(tokens, spark.read.parquet(f"{tmp_path}/people"), 92)
    assert f"{tmp_path}/people" not in _plan(df)
    assert {(r.query_name, r.email) for r in df.collect()} >= {("custmer12", "a12@x")}
    pairs = gramjoin.partial_ratio_join(spark.createDataFrame([("abcd",), ("ab",)], "x string"), spark.createDataFrame([("xabcd",), ("a",)], "x string"), 60)
    assert _plan(pairs).split("== Initial Plan ==")[-1].count("ArrowEvalPython") == 1
    assert {(r.a, r.b) for r in pairs.collect()} == {("abcd", "xabcd"), ("ab", "xabcd"), ("abcd", "a"), ("ab", "a")}


def _positioned(spark, texts, tops):
    rows = [(d, i, 1, t, 10.0, y, 90.0, y + 10, False, 10.0, 0) for d in (1, 2, 3) for i, (t, y) in enumerate(zip(texts, tops, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, line_no int, page int, text string, x0 double, y0 double, x1 double, y1 double, is_bold boolean, font_size double, column int")


def test_sections_read_their_lines_once(spark, tmp_path):
    _positioned(spark, ["WORK EXPERIENCE", "did", "this", "TECHNCAL SKILLS", "sql"], [0.0, 12.0, 24.0, 36.0, 48.0]).write.parquet(f"{tmp_path}/lines")
    out = layout.rule_sections(spark.read.parquet(f"{tmp_path}/lines"))
    assert f"{tmp_path}/lines" not in _plan(out) and "ArrowEvalPython" not in _plan(out)
    assert {(r.doc_id, r.section_type, r.text) for r in out.collect()} == {(d, s, t) for d in (1, 2, 3) for s, t in (("work_experience", "did this"), ("skills", "sql"))}


def test_wrapped_lines_go_on_in_the_next_batch(spark):
    df = _positioned(spark, ["a", "b", "- c", "d", "e", "far"], [0.0, 12.0, 24.0, 36.0, 48.0, 90.0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {(r.doc_id, r.line_no, r.text, r.y1) for r in sections.join_wrapped(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(d, *x) for d in (1, 2, 3) for x in ((0, "a b", 22.0), (2, "- c d e", 58.0), (5, "far", 100.0))}


def test_capitals_are_counted_without_a_match_for_each(spark):
    df = spark.createDataFrame([(t,) for t in ("ABC d", "ABCDEFGHIJ k", "ÄÖ 12", "12", "", None, "𐐀𐐀", "aB")], "t string")
    out = df.select("t", X.all_caps(F.col("t")).alias("caps"))
    assert "extract_all" not in _plan(out)
    assert {r.t: r.caps for r in out.collect()} == {"ABC d": False, "ABCDEFGHIJ k": True, "ÄÖ 12": True, "12": False, "": False, None: False, "𐐀𐐀": True, "aB": False}
