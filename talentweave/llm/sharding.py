"""Shards of near equal bytes by histogram sort.

Rows are ordered by (CRC-32 of the text, hash of the key, hash of the row's place), which brings equal texts together,
spreads all else evenly and lets even equal rows be cut apart. Keys may be of any type. Rounds
count the exact bytes and rows below candidate boundaries, in every partition and added up, and narrow each splitter's
interval until its bytes meet the tolerance; one exchange then deals the rows out. A group of equal texts is only cut
where it is larger than the tolerance, and then by key.

Null texts count as empty. Null and repeated keys are keys like any other; equal rows differ in their slots only, or in
their shards where their group is cut. An empty table gives an empty result. Extra columns are dropped, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.llm.common import cut

SHARDS = 24
#: Share of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.001
#: Rows that one task numbers after the exchange, about.
ROWS_A_TASK = 1_000_000
PROBES = 6_000
LOWEST = -(1 << 63)


def place(crc: np.ndarray, key: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """How many boundaries are at or below each row, in the order of (crc, key)."""
    first = np.array([c for c, _ in bounds], np.int64)
    second = np.array([k for _, k in bounds], np.int64)
    out = np.searchsorted(first, crc, "right")
    low = np.searchsorted(first, crc, "left")
    tied = np.flatnonzero(low < out)
    if len(tied):
        # Rows that share a boundary's CRC are placed by their key, a CRC at a time.
        order = tied[np.argsort(low[tied], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
            a, b = low[part[0]], out[part[0]]
            out[part] = a + np.searchsorted(second[a:b], key[part], "right")
    return out


def below(keys: DataFrame, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each boundary: a histogram in each partition, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            at = place(b.column("crc").to_numpy(), b.column("key").to_numpy(), bounds)
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["bin", "size", "rows"])

    found = keys.select("crc", "key", "size").mapInArrow(run, "bin long, size long, rows long").groupBy("bin").agg(F.sum("size"), F.sum("rows")).collect()
    size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for at, s, r in found:
        size[at], rows[at] = s, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, n: int, tolerance: float) -> list[tuple[tuple[int, int], int]]:
    """n - 1 boundaries that cut the bytes evenly, each with the rows below it. tolerance is in bytes."""
    total, rows, low_key, high_key = keys.agg(F.sum("size"), F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if not rows:
        return [((0, LOWEST), 0)] * (n - 1)
    goal = [total * (i + 1) / n for i in range(n - 1)]
    low = [((0, LOWEST), 0, 0)] * (n - 1)  # boundary, bytes and rows below it
    high = [((1 << 32, LOWEST), total, rows)] * (n - 1)
    best: list = [None] * (n - 1)
    each = max(3, PROBES // max(1, n - 1))
    while open_ := [i for i in range(n - 1) if best[i] is None]:
        probes = set()
        for i in open_:
            (c0, k0), (c1, k1) = low[i][0], high[i][0]
            if c1 - c0 > 1 or (c1 > c0 and k1 > LOWEST):
                probes.update((c, LOWEST) for c in _between(c0, c1 if k1 == LOWEST else c1 + 1, each))
            else:  # within the rows of one CRC
                a = max(k0, low_key - 1)
                b = k1 if c1 == c0 else high_key + 1
                probes.update((c0, k) for k in _between(a, b, each))
        bounds = sorted(probes)
        size, count = below(keys, bounds) if bounds else ((), ())
        at = np.array(size, np.int64)
        for i in open_:
            j = int(np.searchsorted(at, goal[i], "right"))
            for x in (j - 1, j):
                if 0 <= x < len(bounds):
                    point = (bounds[x], int(size[x]), int(count[x]))
                    if point[1] <= goal[i] and low[i][0] < point[0] < high[i][0]:
                        low[i] = point
                    elif point[1] > goal[i] and low[i][0] < point[0] < high[i][0]:
                        high[i] = point
            near = min(low[i], high[i], key=lambda p, g=goal[i]: abs(p[1] - g))
            (c0, k0), (c1, k1) = low[i][0], high[i][0]
            one = c1 - c0 <= 1 and (c1 == c0 or k1 == LOWEST)
            spent = one and (high[i][2] == low[i][2] or (k1 if c1 == c0 else high_key + 1) - max(k0, low_key - 1) <= 1)
            if abs(near[1] - goal[i]) <= tolerance or spent:
                best[i] = near
    return [(p[0], p[2]) for p in sorted(best)]


def _between(a: int, b: int, n: int) -> list[int]:
    """Up to n whole numbers strictly between a and b, evenly spread."""
    if b - a - 1 <= n:
        return list(range(a + 1, b))
    return [a + (b - a) * (i + 1) // (n + 1) for i in range(n)]


def shard(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row. size: UTF-8 bytes of the text plus 8. slot: place in the
    shard, gapless from 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    # The high half from the key, the low half from the row; written once, so that every round sees the same.
    place_bits = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFFFFFF))
    order = F.xxhash64(F.col(key)).bitwiseAND(F.lit(~0xFFFFFFFF)).bitwiseOR(place_bits)
    keys = cut(df.select(F.col(key).alias("id"), order.alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("crc")))
    total, rows = keys.agg(F.sum("size"), F.count(F.lit(1))).first()
    parts = max(4, -(-rows // (shards * ROWS_A_TASK)))
    cuts = splitters(keys, shards * parts, tolerance * (total or 0) / shards)
    bounds = [b for b, _ in cuts]
    starts = [0, *(r for _, r in cuts)]
    spark = df.sparkSession
    # A row for each range that is exchanged: few, however many rows there are.
    offsets = spark.createDataFrame([(i, i // parts, starts[i] - starts[i // parts * parts]) for i in range(shards * parts)], "part int, shard int, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = place(b.column("crc").to_numpy(), b.column("key").to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "part"])

    placed = keys.mapInArrow(run, T.StructType([*keys.schema, T.StructField("part", T.IntegerType())]))
    order = Window.partitionBy("part").orderBy("crc", "key")
    numbered = placed.withColumn("row", F.row_number().over(order))
    return numbered.join(F.broadcast(offsets), "part").select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("row") - 1).alias("slot"))
