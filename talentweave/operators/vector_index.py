"""An exact index for cosine search: cells around centroids, searched by the triangle inequality.

Build: a bounded sample gives centroids; every vector goes to the nearest one's cell and is stored by cell and by its
distance from the centroid, so that partitions, files and row groups carry the ranges that a search prunes by. Search: a
query's distance from a centroid bounds its distance from everything in a cell. Each query visits its nearest cells
until they hold k vectors, which bounds its k-th distance, and then all cells that this bound does not exclude. Both
rounds are joins by cell; neither vectors nor queries pass through the driver.

Distances are chords of unit vectors, |u - v|^2 = 2 * (1 - cosine). Vectors that are null or zero have cosine 0 with
everything and lie in a cell of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions import lexicon as L
from talentweave.operators.retrieval import _matrix, metadata_filter, top_k
from talentweave.sources import scratch

#: Cells at most, vectors that choose their centroids, and vectors of a cell that meet a query's batch at once.
CELLS, SAMPLE, BLOCK = 64, 4096, 2048
#: Distances are ranked after rounding to six places: a cell may hold a result if its bound is no farther than this.
SLACK = 2e-6
#: The cell of vectors without a direction.
NOWHERE = -1


@dataclass(frozen=True)
class VectorIndex:
    """Where an index is, and its cells: (cell, vectors, least and most distance from the centroid, centroid)."""

    path: str
    schema: str
    width: int
    cells: tuple[tuple[int, int, float, float, tuple[float, ...]], ...]

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, vector, meta, radius, cell) of all vectors."""
        return spark.read.schema(T.StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/vectors")


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1))[:, None]
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _centroids(rows: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a sample: farthest-first seeds, then the mean direction of what is nearest."""
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(cells, len(rows)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    at = rows[chosen]
    for _ in range(rounds):
        own = (rows @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, rows)
        moved = _unit(sums)
        at = np.where((moved * moved).sum(1)[:, None] > 0, moved, at)
    return at


def build(store: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Writes the index of all rows below `path` and returns it. Other columns become fields of the struct meta, by
    which a search may filter. The centroids come from the `sample` rows of least hashed id; any choice gives the same
    results. Vectors of different lengths count as filled up with zeros; non-finite components as zeros."""
    spark = store.sparkSession
    rest = [c for c in store.columns if c not in (id_col, vector)]
    meta = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<none: int>")
    rows = store.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("vector"), meta.alias("meta"))
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    picked = rows.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    units = _unit(_matrix(picked, width))
    units = units[(units * units).sum(1) > 0]
    at = _centroids(units, cells) if len(units) else np.zeros((0, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = _unit(_matrix(b.column("vector"), width))
                lost = (own * own).sum(1) == 0
                cosine = own @ at.T if len(at) else np.full((len(own), 1), -1.0)
                cell = np.where(lost | (len(at) == 0), NOWHERE, cosine.argmax(1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(lost, 0.0, _chord(cosine.max(1)))), pa.array(cell)], names=[*b.schema.names, "radius", "cell"])

    dealt = rows.mapInArrow(assign, T.StructType([*rows.schema, T.StructField("radius", T.DoubleType()), T.StructField("cell", T.IntegerType())]))
    # Ranges of cell and radius: a crowded cell is written by several tasks, as files with narrow ranges.
    dealt.repartitionByRange("cell", "radius").sortWithinPartitions("cell", "radius").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    held = spark.read.schema(dealt.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most")).collect()  # a row a cell
    known = [(r.cell, r.n, r.least, r.most, [] if r.cell == NOWHERE else at[r.cell].tolist()) for r in sorted(held, key=lambda r: r.cell)]
    spark.createDataFrame([(json.dumps({"schema": dealt.schema.json(), "width": width, "cells": known}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/cells")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> VectorIndex:
    """The index that build() has written there."""
    found = json.loads(spark.read.text(f"{path}/cells").first()[0])
    return VectorIndex(path, found["schema"], found["width"], tuple((c, n, a, b, tuple(v)) for c, n, a, b, v in found["cells"]))


def _bounds(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """(qid, weight, q, bounds, first): of each query a lower bound of its distance to what each cell holds, and the
    nearest cells that hold k vectors together, both by the cell's place in the index."""
    kind = dict(queries.dtypes)["qid"]
    cells, width = index.cells, index.width
    n = np.array([c[1] for c in cells])
    least, most = np.array([c[2] for c in cells]), np.array([c[3] for c in cells])
    placed = np.array([c[0] != NOWHERE for c in cells])
    at = np.array([[*c[4], *[0.0] * (width - len(c[4]))] for c in cells])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            full = _matrix(b.column("q"), max(width, pa.compute.max(pa.compute.list_value_length(b.column("q"))).as_py() or 0))
            norm = np.sqrt((full * full).sum(1))[:, None]
            # What a query has beyond the index's width only takes from its cosines: a point inside the sphere.
            own = np.divide(full[:, :width], norm, out=np.zeros((len(full), width)), where=norm > 0)
            away = np.sqrt(np.maximum((own * own).sum(1)[:, None] + 1 - 2 * own @ at.T, 0))
            gap = np.maximum(np.maximum(away - most, least - away), 0)
            # 1 - cosine = (|u - v|^2 + 1 - |u|^2) / 2
            bound = np.where(placed, (gap * gap + 1 - (own * own).sum(1)[:, None]) / 2, 1.0)
            bound = np.where(norm > 0, bound, 1.0)
            order = np.argsort(bound, axis=1, kind="stable")
            enough = (np.cumsum(n[order], axis=1) < k).sum(1) + 1
            first = [order[i, : enough[i]].tolist() for i in range(len(order))]
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("weight"), b.column("q"), pa.array(list(bound)), pa.array(first, pa.list_(pa.int32()))], names=["qid", "weight", "q", "bounds", "first"])

    asked = queries.select("qid", F.col("weight").cast("double").alias("weight"), F.expr("transform(coalesce(embedding, array()), x -> cast(x as double))").alias("q"))
    return asked.mapInArrow(work, f"qid {kind}, weight double, q array<double>, bounds array<double>, first array<int>")


def _visit(index: VectorIndex, store: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(qid, weight, id, dist): of each visit (qid, weight, q, place) the k nearest vectors of the cell, block by block."""
    kinds, own = dict(visits.dtypes), dict(store.dtypes)["id"]
    cells = visits.sparkSession.createDataFrame([(i, c[0], max(1, -(-c[1] // BLOCK))) for i, c in enumerate(index.cells)], "place int, cell int, blocks int")
    size = F.create_map(*[F.lit(x) for c in index.cells for x in (c[0], max(1, -(-c[1] // BLOCK)))])
    asked = visits.join(F.broadcast(cells), "place").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qid", "weight", "q")
    # Cells that nobody visits are not read: a partition filter that the join brings.
    wanted = visits.select("place").distinct().join(F.broadcast(cells), "place").select("cell")
    held = store.join(F.broadcast(wanted), "cell", "left_semi").select(F.col("cell").alias("cell"), F.pmod(F.xxhash64("id"), F.element_at(size, F.col("cell"))).cast("int").alias("block"), "id", "vector")

    def near(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"qid": [], "weight": [], "id": [], "dist": []})
        longest = max(1, *map(len, q["q"]), *(len(v) for v in x["vector"] if v is not None))
        a, b = _matrix(pa.array(q["q"]), longest), _matrix(pa.array(x["vector"], pa.list_(pa.float64())), longest)
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
        dots = a @ b.T
        dist = np.round(1 - np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0), 6) + 0.0
        last = min(k, len(x)) - 1
        i, j = np.nonzero(dist <= np.partition(dist, last, axis=1)[:, last : last + 1])
        return pd.DataFrame({"qid": q["qid"].to_numpy()[i], "weight": q["weight"].to_numpy()[i], "id": x["id"].to_numpy()[j], "dist": dist[i, j]})

    return asked.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInPandas(near, f"qid {kinds['qid']}, weight double, id {own}, dist double")


def plan(index: VectorIndex, queries: DataFrame, k: int = L.PER_QUERY, where: dict[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """(visits, hits): the cells (qid, cell, vectors, round) that each query visits, and the hits (qid, weight, id, dist,
    rank) that search() returns."""
    spark = queries.sparkSession
    store = index.table(spark)
    if where:
        store = metadata_filter(store, {f"meta.`{c}`": v for c, v in where.items()})
    asked = scratch.written(_bounds(index, queries, k))
    first = asked.select("qid", "weight", "q", F.explode("first").alias("place"))
    hits = scratch.written(top_k(_visit(index, store, first, k), k))
    # The k-th distance so far; without k hits every cell is visited.
    reached = hits.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("limit"))
    rest = asked.join(reached, "qid", "left").select("qid", "weight", "q", "first", "limit", F.posexplode("bounds").alias("place", "bound"))
    second = rest.where(~F.array_contains("first", F.col("place")) & (F.col("limit").isNull() | (F.col("bound") <= F.col("limit") + SLACK))).select("qid", "weight", "q", "place")
    more = top_k(_visit(index, store, second, k), k)
    cells = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(index.cells)], "place int, cell int, vectors long")
    visits = first.select("qid", "place", F.lit(1).alias("round")).unionByName(second.select("qid", "place", F.lit(2).alias("round"))).join(F.broadcast(cells), "place")
    return visits.select("qid", "cell", "vectors", "round"), top_k(hits.unionByName(more).drop("rank"), k)


def search(index: VectorIndex, queries: DataFrame, k: int = L.PER_QUERY, where: dict[str, object] | None = None) -> DataFrame:
    """(qid, weight, id, dist, rank): the same rows as retrieval.knn gives for queries (qid, weight, embedding) of any
    number, whose qid is unique. `where` filters by other columns of the store (retrieval.metadata_filter) and reaches
    the files."""
    if not index.cells:
        return queries.sparkSession.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, weight double, id {dict(index.table(queries.sparkSession).dtypes)['id']}, dist double, rank int")
    return plan(index, queries, k, where)[1]
