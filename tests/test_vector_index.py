"""The exact vector index against a scan of all vectors."""

import random

import pytest
from pyspark.sql import functions as F

from talentweave.operators import retrieval
from talentweave.operators import vector_index as V


def clustered(seed, n=400, width=8, groups=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    rows = [(i, [float(c + rng.gauss(0, 0.05)) for c in centres[min(i % 12, groups - 1)]], f"l{i % 3}") for i in range(n)]
    return rows + [(900, None, "l0"), (901, [0.0] * width, "l1"), (902, [], None), (903, rows[5][1], "l2"), (904, rows[5][1][:3], "l1"), (5, rows[5][1], "l2")]


def key(r):
    return (r.qid, r.rank, r.id, r.weight, r.dist)


@pytest.mark.parametrize(("k", "where"), [(1, None), (7, None), (5, {"a.b": ["l0", "l1"]}), (200, {"a.b": "l2"}), (500, None)])
def test_search_equals_a_scan(spark, tmp_path, k, where):
    rows = clustered(3)
    store = spark.createDataFrame(rows, "id int, embedding array<double>, `a.b` string").withColumns({"cell": F.lit("x"), "radius": F.lit(1), "vector": F.lit(0)})
    index = V.build(store, str(tmp_path / "index"), cells=9, sample=100)
    assert V.read(spark, str(tmp_path / "index")) == index and sum(c[1] for c in index.cells) == len(rows)
    asked = [(i, 1.0 + i, rows[i][1]) for i in range(0, 40, 3)] + [(1000, 1.0, None), (1001, 1.0, [0.0] * 8), (1002, 2.0, [1.0] * 11), (1003, 1.0, [0.5])]
    queries = spark.createDataFrame(asked, "qid int, weight double, embedding array<double>")
    scanned = retrieval.metadata_filter(store, {f"`{c}`": v for c, v in (where or {}).items()})
    want = retrieval.knn(scanned, queries, k)
    assert sorted(map(key, V.search(index, queries, k, where).collect())) == sorted(map(key, want.collect()))


def test_far_cells_are_not_visited(spark, tmp_path):
    rows = [r for r in clustered(4, n=600) if r[1] and any(r[1])]
    store = spark.createDataFrame(rows, "id int, embedding array<double>, label string")
    index = V.build(store, str(tmp_path / "index"), cells=6)
    queries = spark.createDataFrame([(i, 1.0, rows[i][1]) for i in range(12)], "qid int, weight double, embedding array<double>")
    visits, hits = V.plan(index, queries, 5, {"label": "l1"})
    seen = visits.groupBy("qid").agg(F.sum("vectors").alias("n")).agg(F.avg("n")).first()[0]
    assert seen < 0.75 * len(rows)
    text = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in text.lower() or "LeftSemi" in text
    scan = index.table(spark).where("meta.label = 'l1' and cell = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(meta.label), EqualTo(meta.label,l1)]" in scan and "PartitionFilters: [isnotnull(cell" in scan


def test_an_empty_store_and_no_queries(spark, tmp_path):
    store = spark.createDataFrame(clustered(5, n=20), "id int, embedding array<double>, label string")
    queries = spark.createDataFrame([(0, 1.0, [1.0] * 8)], "qid int, weight double, embedding array<double>")
    empty = V.build(store.limit(0), str(tmp_path / "a"))
    assert empty.cells == () and V.search(empty, queries).count() == 0
    assert V.search(V.build(store, str(tmp_path / "b")), queries.limit(0)).count() == 0
    lost = V.build(store.where("id in (900, 901)"), str(tmp_path / "c"))
    assert [(r.id, r.dist) for r in V.search(lost, queries, 5).orderBy("rank").collect()] == [(900, 1.0), (901, 1.0)]
