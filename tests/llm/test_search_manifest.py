"""Hard negatives, top-k search and the Merkle manifest against plain versions of them."""

import math
import os
import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.llm import hard_negatives, merkle, queries, topk_search, vectors

SF = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<float>, label int"


def whole(x):
    """The integer vector of an embedding, None where it takes no part."""
    if x is None or any(v is None or not math.isfinite(v) for v in x):
        return None
    return [max(-vectors.CLAMP, min(vectors.CLAMP, math.floor(256 * float(np.float32(v))))) for v in x]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, k=5):
    held = [(i, v) for i, e, _ in rows if i is not None and (v := whole(e)) is not None]
    asked = {}
    for i, v in held:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        found = sorted((-dot(a, v), i) for i, v in held if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def brute_negatives(rows):
    held = [(i, label, v) for i, e, label in rows if i is not None and label is not None and (v := whole(e)) is not None]
    anchors = {}
    for i, label, v in held:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, own) in anchors.items():
        ranked = sorted((-dot(own, v), i, x) for i, x, v in held if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            fit = [(i, -t) for t, i, x in ranked if x != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(fit)]
    return sorted(out)


def made(seed, n=260, width=6, hot=80):
    """Vectors with a hot group of near and exact copies, ties, unsound and short vectors, repeated rows."""
    rng = random.Random(seed)
    near = [rng.choice((-0.5, 0.25, 0.75)) for _ in range(width)]
    rows = []
    for i in range(n):
        v = [x + (rng.random() < 0.1) / 256 for x in near] if i < hot else [rng.choice((-0.5, -0.1, 0.0, 0.3, 0.8)) for _ in range(width)]
        rows.append((i * 5, v, rng.randint(0, 3)))
    rows += [(7, None, 1), (50, [math.nan] * width, 1), (9, [None] * width, 0), (11, [math.inf] + [0.0] * (width - 1), 0), (None, [0.5] * width, 0)]
    rows += [(12, [0.9], 1), (13, [], 2), (14, [0.4] * width, None), (16, [1e30] + [0.0] * (width - 1), 1), *rows[90:93], (100, [0.3] * width, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_top_k_equals_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, KINDS)
    index = topk_search.build(df, block=40, levels=(16, 3, 1)[seed])
    got = topk_search.search(index, df.where("vec_id % 50 = 0"), group=3)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_equal_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, KINDS)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, pivots=(5, 1, 64)[seed], group=3, block=20)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_a_search_stops_before_the_last_segment_and_stays_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=32) * (3 if i < 20 else 0.1)], 0) for i in range(600)]
    df = spark.createDataFrame(rows, KINDS)
    index = topk_search.build(df)
    held = index.segments.toPandas().sort_values("impact", ascending=False)
    q = np.array([whole(rows[0][1])])
    want = q @ np.array([whole(e) for _, e, _ in rows]).T
    floor = np.array([np.sort(want[0])[-6]])
    seen = []
    real = np.einsum

    def counted(*a, **b):
        seen.append(len(a[1]))
        return real(*a, **b)

    topk_search.np.einsum = counted
    try:
        slot, _, score = topk_search.members(held, 600, q, floor, index.largest)
    finally:
        topk_search.np.einsum = real
    ids = np.array(held["ids"].dropna().iloc[0])
    assert seen and sum(seen) < 100
    assert sorted(zip(ids[slot], score, strict=True)) == sorted((i, s) for i, s in enumerate(want[0]) if s >= floor[0])


def test_vectors_in_tables_without_rows_and_with_other_columns(spark):
    none = spark.createDataFrame([], KINDS)
    assert topk_search.search(topk_search.build(none), none).count() == 0
    assert hard_negatives.hard_negatives(none, F.lit(True)).count() == 0
    rows = made(4, n=60, hot=10)
    named = spark.createDataFrame([(*r, 1, "x", {"a": 1}) for r in rows], KINDS + ", id int, score string, `a.b` map<string, int>").withColumns({"cell": F.lit(3), "v": F.lit("x"), "is_anchor": F.lit(False), "rank": F.lit(0)})
    assert sorted(map(tuple, topk_search.search(topk_search.build(named), named.where("vec_id % 50 = 0")).collect())) == brute_top(rows)
    assert sorted(map(tuple, hard_negatives.hard_negatives(named, F.col("vec_id") % 50 == 0).collect())) == brute_negatives(rows)


def test_products_beyond_doubles_are_exact():
    a = np.full((1, 3), vectors.CLAMP)
    b = np.array([[vectors.CLAMP, vectors.CLAMP - 1, 3]])
    for _ in range(8):
        a, b = np.c_[a, a], np.c_[b, b]
    assert vectors.products(a, b)[0, 0] == sum(int(x) * int(y) for x, y in zip(a[0], b[0], strict=True))


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_proof(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        a = i // fanout * fanout
        out.append((level[a:i], level[i + 1 : a + fanout]))
        i //= fanout
    return out


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [(2, 2, (1, 2, 5, 9, 17)), (3, 1, (1, 3, 4, 28)), (16, 2, (300, 1)), (4, 3, (70,))])
def test_manifest_equals_a_plain_tree(spark, fanout, levels, sizes):
    rng = random.Random(fanout)
    rows = [(rng.randint(0, 40) if rng.random() < 0.9 else None, f"g{g}" if g else None, f"t{rng.randint(0, 9)}" if rng.random() < 0.9 else None) for g, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "k int, g string, t string").withColumns({"node": F.lit(1), "idx": F.lit("x"), "a.b": F.lit(0), "grp": F.lit(2)})
    found = merkle.manifest(df, merkle.digest("k", "t"), "k", "g", fanout=fanout, levels=levels).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for name in sorted({r[1] for r in rows}, key=lambda x: (x is not None, x or "")):
        own = sorted(((r[0] is not None, r[0] or 0, h([field(r[0]), field(r[2])])) for r in rows if r[1] == name))
        trees[name] = (plain_tree([x[2] for x in own], fanout), own)
    top = plain_tree([t[0][-1][0] for t in trees.values()], fanout)
    want = []
    for j, (name, (tree, own)) in enumerate(trees.items()):
        for i, (there, k, leaf) in enumerate(own):
            proof = plain_proof(tree, i, fanout) + plain_proof(top, j, fanout)
            want.append((k if there else None, name, leaf, i, tree[-1][0], top[-1][0], proof))
    got = sorted(repr((r.k, r.g, r.leaf, r["index"], r.subroot, r.root, [(p.before, p.after) for p in r.proof])) for r in found)
    for a, b in zip(sorted(map(repr, want)), got, strict=True):
        assert a == b
    again = spark.createDataFrame([(r.leaf, r.root, r.proof) for r in found], f"leaf string, root string, proof {merkle.PROOF}").withColumn("ok", merkle.folded() == F.col("root"))
    assert again.where("not ok").count() == 0


def test_manifests_tell_which_groups_changed(spark):
    old = spark.createDataFrame([(i, f"s{i % 4}", "x") for i in range(40)] + [(50, None, "y")], "k int, g string, t string")
    new = old.where("g is distinct from 's3'").withColumn("t", F.when(F.col("k") == 6, "z").otherwise(F.col("t"))).union(spark.createDataFrame([(1, "new", "n")], old.schema))
    of = lambda df: merkle.manifest(df, merkle.digest("k", "t"), "k", "g")
    got = {r.g: (r.old_root is None, r.new_root is None) for r in merkle.changed(of(old), of(new), "g").collect()}
    assert got == {"s2": (False, False), "s3": (False, True), "new": (True, False)}
    assert merkle.manifest(old.limit(0), merkle.digest("k"), "k", "g").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle", "op13_topk"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()))
    assert got == sorted(duck.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall())


def test_manifest_query_on_odd_rows(spark, tmp_path):
    """Null columns, empty and very long texts, repeated rows: query and SQL agree."""
    rows = [(i, None if i % 7 == 0 else "AÉ" * i, "de" if i % 2 else None, ("web", None, "ünï")[i % 3], i if i % 5 else None) for i in range(60)]
    rows += [rows[3], rows[3], (None, "A b", "en", "web", 3), (61, "", "en", "one", 0), (62, "Ab " * 200_000, "en", "web", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op12_merkle(spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got == sorted(map(repr, duck.sql(f"select {', '.join(columns)} from ({queries.OP12_SQL})").fetchall()))
    assert any("False" in r for r in got)
