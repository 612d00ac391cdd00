import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from talentweave.llm import queries
from tests.llm.test_models import junk, prose
from tests.llm.test_simhash_sharding import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NAMELESS = "a text without an id that no other document is like in any of its words " * 3
ITEM = " ".join(f"item{i}" for i in range(20))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = [prose(rng, 120) + "\n" + prose(rng, 40) for _ in range(120)]
    good = len(texts)
    texts += ["\n".join(junk(rng) for _ in range(3)) for _ in range(60)]
    labels = [(i, int(i < good), 0) for i in range(len(texts))]
    texts += [texts[0], texts[1] + " ", ITEM + " " + texts[2][:40], texts[3].replace("word1 ", "write me@x.example.org ", 1) + " me@x.example.org", None, ""]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "src0", len(texts[5]))]
    rows += [(None, texts[7], None, None, None), (None, NAMELESS, None, None, None), (None, NAMELESS, None, None, None), (None, NAMELESS[::-1], None, None, None)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_do_what_their_operators_decide(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(P.STAGES)
    good = steps["quality"](spark, docs, folder)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == COLUMNS and set(range(120)) <= kept and not kept & set(range(120, 180))

    one = steps["near-duplicates"](spark, docs, folder).collect()
    rows = docs.collect()
    named = [r for r in rows if r.doc_id is not None]
    want = set(brute_components([r.doc_id for r in named], [brute_fingerprint(r.text) for r in named], 2))
    assert sorted(r.doc_id for r in one if r.doc_id is not None) == sorted(want)
    assert sorted(r.text for r in one if r.doc_id is None) == sorted([NAMELESS, NAMELESS[::-1]])

    clean = steps["decontamination"](spark, docs, folder)
    assert clean.columns == COLUMNS and {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {182}

    hidden = {r.doc_id: r for r in steps["personal-data"](spark, docs, folder).collect()}
    before = {r.doc_id: r.text for r in rows}
    assert "@" not in hidden[183].text and hidden[183].n_chars == len(hidden[183].text)
    assert {k for k, r in hidden.items() if r.text != before[k]} == {183}


def test_rows_that_share_an_id_stay_unless_they_are_alike(spark):
    one, other = "first of two texts that share an id but hardly any word at all", "quite another thing stands here and nobody would take it for a copy"
    rows = [(7, one, "b", 1.0), (7, one, "a", 2.0), (7, other, "c", 3.0), (3, other + " ", "d", 4.0), (None, one, "e", 5.0), (9, None, "f", 6.0), (8, "", "g", 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, n_words double")
    got = dict(P.STAGES)["near-duplicates"](spark, docs, "")
    assert got.columns == docs.columns and sorted((r.doc_id, r.text_hash) for r in got.collect()) == [(3, "d"), (7, "a"), (8, "g")]


def test_columns_named_like_the_stages_own_stay(spark, folder):
    names = ["score", "spans", "decoded", "n_words", "n_hit", "hit_items", "hit_spans", "fp", "row", "text_hash"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id in (4, 183)").selectExpr("*", *(f"'{n}' as {n}" for n in names))
    for name, stage in P.STAGES:
        got = stage(spark, docs, folder)
        assert got.columns[: len(docs.columns)] == docs.columns and len(rows := got.collect()) == 2, name
        assert all(r[n] == n for r in rows for n in names)


def test_columns_of_any_type_and_name_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id in (4, 5, 183)")
    docs = docs.withColumns({"m": F.create_map(F.lit("k"), F.lit(2)), "a.b": F.lit("dot"), "t`ick": F.lit("tick"), "_p": F.lit(1), "_over": F.lit(2), "root": F.lit(3)})
    # Of the two rows with id 5 the one with the smaller map stays.
    twice = docs.withColumn("m", F.when(F.col("doc_id") == 5, F.create_map(F.lit("k"), F.lit(1))).otherwise(F.col("m")))
    for name, stage in P.STAGES:
        rows = stage(spark, docs.union(twice), folder)
        assert rows.columns[: len(docs.columns)] == docs.columns, name
        got = rows.collect()
        assert all((r["a.b"], r["t`ick"], r["_p"], r["_over"], r["root"]) == ("dot", "tick", 1, 2, 3) for r in got) and {r.doc_id for r in got} == {4, 5, 183}, name
        if name == "near-duplicates":
            assert sorted((r.doc_id, r.m["k"]) for r in got) == [(4, 2), (5, 1), (183, 2)]


def test_run_gives_tokens_of_what_is_left(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    got = P.run(spark, folder).collect()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert len(set(ids)) == len(ids) and not set(ids) & {*range(120, 180), 180, 181, 182} and set(range(4, 120)) <= set(ids)
    for r in got:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_an_empty_table_runs_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_queries_of_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    other = {"op2_html": 50, "op11_hard_negatives": 150, "op13_topk": 50}
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).count() == other.get(name, n), name


