"""Exact top-k search by an impact-ordered index, score at a time.

The index deals the vectors to blocks of bounded size. A block holds a posting (slot, value) for each component that is
not zero, in segments: all postings of one quantised impact, that is of the size of the value in LEVELS steps of the
table's largest, by dimension. A search reads a block's segments from the highest impact down and adds up the scores of
all its vectors for many queries at once. After each segment it knows of every vector the norm of what has not been read,
so the Cauchy-Schwarz inequality bounds its score; who cannot reach a score that k vectors are known to have is out.
Reading stops when scoring the possible members exactly takes less work than reading on; a member that the bound does
not exclude is always scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.common import cut, give_back
from talentweave.llm.vectors import EXACT, best, integers, kth, packed, products, to_bytes, unpacked

#: Steps of impact; vectors in a block on average, fewer where they are wide; queries that meet a block at once.
LEVELS, BLOCK, GROUP = 16, 2048, 1024
CELLS = 4_000_000
#: Stored vectors that give every query its first bound.
PROBES = 512
NONE = -(1 << 62)


class Index:
    """An index as a table, with what a search must know of it.

    segments: (block, impact, dims, slots, counts, values, ids): counts[i] postings of dims[i] follow each other in slots
    and values; ids, the vectors by slot, stand with the segment of the highest impact.
    """

    def __init__(self, segments: DataFrame, blocks: int, width: int, largest: int, probes: list):
        self.segments, self.blocks, self.width, self.largest, self.probes = segments, blocks, width, largest, probes


def build(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", levels: int = LEVELS, block: int = BLOCK) -> Index:
    """The index of all sound vectors (vectors.integers), written to the shared folder. Repeated rows are indexed as
    often as they stand; an empty table gives an index without segments."""
    rows = integers(vectors, id_col, vector)
    kind = dict(rows.dtypes)["id"]
    n, width, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.expr("coalesce(array_max(transform(v, x -> abs(x))), 0)"))).first()
    width, largest = max(width or 0, 1), max(largest or 0, 1)
    probes = rows.orderBy(F.xxhash64("id"), "id", "v").limit(PROBES).collect()
    blocks = max(1, -(-n // max(1, min(block, CELLS // width))))

    def segments(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("no")
        x = packed(frame["v"].tolist(), width)
        slot, dim = np.nonzero(x)
        value = x[slot, dim]
        impact = -(-np.abs(value) * levels // largest)
        order = np.lexsort((slot, dim, -impact))
        slot, dim, value, impact = slot[order], dim[order], value[order], impact[order]
        out = []
        for level in range(levels, 0, -1):
            a, b = np.searchsorted(-impact, [-level, -level + 1])
            if a == b and level < levels:
                continue
            dims, counts = np.unique(dim[a:b], return_counts=True)
            ids = frame["id"].to_numpy() if level == levels else None
            out.append((int(frame["block"].iloc[0]), level, dims, counts, slot[a:b], value[a:b], ids))
        return pd.DataFrame(out, columns=["block", "impact", "dims", "counts", "slots", "values", "ids"])

    # Numbers are written first, so that every attempt of a task deals a row to the same block.
    numbered = cut(rows.withColumn("no", F.monotonically_increasing_id()))
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int"))
    table = dealt.groupBy("block").applyInPandas(segments, f"block int, impact int, dims array<int>, counts array<int>, slots array<int>, values array<int>, ids array<{kind}>")
    return Index(cut(table), blocks, width, largest, probes)


def search(index: Index, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", group: int = GROUP) -> DataFrame:
    """(query_id, rank, id, score): of each query the k vectors of the largest integer inner product, ties to the smaller
    id; all, if there are fewer. Exact.

    A query meets every indexed row but those of its own id. Queries without an id or a sound vector give no rows;
    queries that share an id count once, as the least vector. Components beyond the index's width meet nothing.
    """
    asked = integers(queries, id_col, vector).groupBy("id").agg(F.min("v").alias("v"))
    kind, own = dict(asked.dtypes)["id"], dict(index.segments.dtypes)["ids"][6:-1]
    width, largest = index.width, index.largest
    probes = packed([r.v for r in index.probes], width)
    places: dict = {}
    for j, r in enumerate(index.probes):
        places.setdefault(r.id, []).append(j)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = packed([v[:width] for v in b.column("v").to_pylist()], width)
                allowed = np.ones((len(q), len(probes)), bool)
                for i, x in enumerate(b.column("id").to_pylist()):
                    allowed[i, places.get(x, [])] = False
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(to_bytes(q), pa.binary()), pa.array(kth(k, products(q, probes), allowed, NONE))], names=["id", "v", "floor"])
        give_back()

    # Each query with a score that its k-th result reaches for sure.
    bounded = cut(asked.mapInArrow(floors, f"id {kind}, v binary, floor long"))
    groups = max(1, -(-bounded.count() // group))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = bounded.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).select("part", every(index.blocks).alias("block"), "id", "v", "floor")
    held = index.segments.select(every(groups).alias("part"), "*")

    def scored(q: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(segments):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        ids = np.array(segments["ids"].dropna().iloc[0])
        slot, of, score = members(segments.sort_values("impact", ascending=False), len(ids), unpacked(q["v"], width), q["floor"].to_numpy(), largest)
        asker, found = q["id"].to_numpy()[of], ids[slot]
        other = asker != found
        asker, found, score, of = asker[other], found[other], score[other], of[other]
        order = found if found.dtype.kind in "iu" else np.unique(found.astype(object), return_inverse=True)[1]
        at = best(k, of, score, order)
        return pd.DataFrame({"query_id": asker[at], "id": found[at], "score": score[at]})

    pairs = sent.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInPandas(scored, f"query_id {kind}, id {own}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def members(segments: pd.DataFrame, n: int, q: np.ndarray, floor: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, query, score) of all vectors of a block, n in number, whose score may reach the query's floor."""
    width = q.shape[1]
    exact_in_doubles = float(np.abs(q).max(initial=0)) * largest * width < EXACT
    number = np.float64 if exact_in_doubles else np.int64
    by_dim = np.ascontiguousarray(q.T.astype(number))
    length = np.sqrt((q * q).sum(1).astype(np.float64)) * (1 + 1e-12)
    parts = [(np.repeat(d, c), np.asarray(s), np.asarray(v), np.asarray(d), np.asarray(c)) for d, c, s, v in zip(segments["dims"], segments["counts"], segments["slots"], segments["values"], strict=True)]
    unread = np.zeros(n)  # squared norm of what has not been read
    for _, slot, value, _, _ in parts:
        unread += np.bincount(slot, value.astype(np.float64) ** 2, n)
    left = sum(len(p[1]) for p in parts)
    total = np.zeros((n, len(q)), number)
    for i, (_, slot, value, dims, counts) in enumerate(parts):
        begin = 0
        for d, c in zip(dims, counts, strict=True):
            at = slot[begin : begin + c]
            total[at] += value[begin : begin + c, None].astype(number) * by_dim[d]  # a slot stands once in a dimension
            begin += c
        unread -= np.bincount(slot, value.astype(np.float64) ** 2, n)
        left -= len(slot)
        reach = np.sqrt(np.maximum(unread, 0)) * (1 + 1e-9) + 1e-3
        possible = total + reach[:, None] * length[None] >= floor[None]
        if possible.sum() * width <= left * len(q) or not left:
            break
    at, of = np.nonzero(possible) if parts else (np.zeros(0, np.int64),) * 2
    score = total[at, of].astype(np.int64)
    if left:
        rest = np.zeros((n, width), np.int64)
        for dim, slot, value, _, _ in parts[i + 1 :]:
            rest[slot, dim] = value
        step = max(1, CELLS // width)
        for a in range(0, len(at), step):
            score[a : a + step] += np.einsum("ij,ij->i", rest[at[a : a + step]], q[of[a : a + step]])
    reached = score >= floor[of]
    return at[reached], of[reached], score[reached]
