import random

import numpy as np
import pytest
import xxhash

from talentweave.llm import sharding, simhash

WORDS = [f"w{i}" for i in range(30)]


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(keys, fps, radius):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[top(i)] = top(j)
    least = {}
    for i, k in enumerate(keys):
        least[top(i)] = min(least.get(top(i), k), k)
    return [least[top(i)] for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(40)]
    texts = base + [b.replace("w1 ", "W1\t") for b in base] + [b + " tail" for b in base] + [None, "", " \n", "one", "Two words", "\xa0", "a  b c"] + base[:5] * 3
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[k].fingerprint & (2**64 - 1) for k, *_ in rows] == fps
    assert [got[k].component_id for k, *_ in rows] == brute_components([k for k, *_ in rows], fps, 2)


def test_chains_of_links_are_followed(spark):
    fps, fp = [], 0
    for i in range(40):  # a chain of steps of two bits, and far points
        fps.append(fp)
        fp ^= 3 << (i % 20 * 3)
    fps += [(1 << 63) | 0x5555, (1 << 63) | 0x5554, (1 << 63) - 1]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in dict.fromkeys(fps)]
    roots = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    root = {r.node: r.root for r in roots}
    want = brute_components([f for f, in signed], [f & (2**64 - 1) for f, in signed], 2)
    assert [root.get(f, f) for f, in signed] == want
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed, "fp long"), 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert sharding.shard(df).count() == 0


def shards_of(df, **more):
    rows = [r.asDict() for r in sharding.shard(df, **more).collect()]
    n = more.get("shards", sharding.SHARDS)
    size = np.zeros(n, int)
    slots = {}
    for r in rows:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, size


def test_shards_are_even_gapless_and_keep_groups(spark):
    rng = random.Random(4)
    texts = [f"text {rng.random()} " * rng.randint(1, 30) for _ in range(3000)] + ["ten copies each %d " % (i % 60) * 8 for i in range(600)]
    rows = [(i, t, 9) for i, t in enumerate(texts)]
    got, size = shards_of(spark.createDataFrame(rows, "doc_id long, text string, shard int"), shards=6, tolerance=0.05)
    assert len(got) == len(rows) and size.max() - size.min() <= 0.1 * size.mean() + 1200
    where = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_a_group_larger_than_a_shard_is_cut_by_key(spark):
    rows = [(i, "the same text") for i in range(500)] + [(1000 + i, f"other {i}") for i in range(400)] + [(None, None), (None, ""), (7, "the same text")]
    got, size = shards_of(spark.createDataFrame(rows, "doc_id long, text string"), shards=7, tolerance=0.01)
    assert len(got) == len(rows) and size.max() - size.min() <= 60


def test_repeated_rows_and_fewer_rows_than_shards(spark):
    got, _ = shards_of(spark.createDataFrame([(1, "a")] * 5 + [(2, None)], "doc_id long, text string"))
    assert sorted(r["size"] for r in got) == [8] + [9] * 5


def test_tables_between_rounds_can_be_dropped(spark):
    import os

    from talentweave.llm import common

    df = common.cut(spark.range(5).toDF("a"))
    place = common._tables(spark).removeprefix("file:")
    assert df.count() == 5 and os.listdir(place)
    common.drop_tables(spark)
    assert not os.path.exists(place)


def test_keys_of_any_type_and_equal_rows(spark):
    rows = [("a", "t" * 50)] * 3000 + [(None, "t" * 50)] * 3000 + [(f"k{i}", f"text {i}") for i in range(500)]
    got = sharding.shard(spark.createDataFrame(rows, "size string, text string"), shards=6, key="size").toPandas()
    got.columns = ["id", *got.columns[1:]]
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 6500 and len(sizes) == 6 and sizes.max() - sizes.min() < 0.01 * sizes.mean() + 120
    assert all(sorted(own) == list(range(len(own))) for _, own in got.groupby("shard")["slot"])
