"""Hard-negative mining by a Voronoi-partitioned, distributed k-nearest-neighbour join.

Every stored vector x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, and every anchor a zero:
then |q - x|^2 = |q|^2 + M - 2 q.x, and the largest inner product is the nearest vector. Vectors belong to the nearest of
some pivots (a cell); anchors whose nearest pivots are neighbours form a group. From the extent of a group around each
pivot and from scores that its anchors are sure to reach, the triangle inequality tells at which radii of a cell a
vector may serve the group: it is sent to those groups alone, and there an exact join by matrix products decides.

Two joins run one after the other: the positives of each anchor (same label), then, for the window of scores that each
positive leaves open, the negatives (other labels).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.common import cut, give_back
from talentweave.llm.vectors import best, integers, kth, packed, products, to_bytes, unpacked

#: Cells, at most; and stored vectors, the pivots among them, that give every anchor its first bounds.
PIVOTS, PROBES = 64, 512
#: Anchors that meet a block of vectors at once, and vectors in such a block, at most on average.
GROUP, BLOCK = 1024, 512
#: Slack of the bounds, relative to the vectors' norm: far above the rounding of distances.
SLACK = 1e-6
NONE = -(1 << 62)


class Pivots:
    """The pivots and probes of a table: small, sent with each task."""

    def __init__(self, rows: list, width: int, top: int, pivots: int):
        self.width, self.top, self.norm = width, top, float(top) ** 0.5 + 1
        self.ids = [r.id for r in rows]
        self.labels = np.array([r.label for r in rows], np.int64)
        self.v = packed([r.v for r in rows], width)
        self.n = min(pivots, len(rows))
        own = self.v[: self.n]
        self.lift = np.sqrt(np.maximum(top - (own * own).sum(1), 0).astype(float))

    def radii(self, v: np.ndarray) -> np.ndarray:
        """Distances of stored vectors from each pivot."""
        lift = np.sqrt(np.maximum(self.top - (v * v).sum(1), 0).astype(float))
        square = 2.0 * self.top - 2.0 * (products(v, self.v[: self.n]) + lift[:, None] * self.lift[None])
        return np.sqrt(np.maximum(square, 0))

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors from each pivot."""
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.top - 2.0 * products(q, self.v[: self.n]), 0))

    def others(self, ids: list) -> np.ndarray:
        """Which probes are not the anchor itself."""
        at: dict = {}
        for j, own in enumerate(self.ids):
            at.setdefault(own, []).append(j)
        out = np.ones((len(ids), len(self.ids)), bool)
        for i, own in enumerate(ids):
            out[i, at.get(own, [])] = False
        return out


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, pivots: int = PIVOTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and
    positive.

    A score is the integer inner product with the anchor (vectors.integers says how components become integers). An
    anchor's positives are the first `positives` other rows of its label, its negatives for one of them the first
    `negatives` rows of other labels whose score is from low to high hundredths of the positive's; higher scores come
    first, then smaller ids. `anchors` is a condition on the input's columns.

    Rows with a null id or label, or an unsound vector, take no part; vectors of different lengths count as filled up
    with zeros. Each repeated row takes a place of its own, though never beside its own id; anchors that share an id
    count once, as that with the least label and vector. Anchors without a positive or a negative give no row, an empty
    table gives none. Other columns, of any name, go.
    """
    flagged = vectors.select(F.col(id_col).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = integers(flagged.where(F.col("label").isNotNull()), "id", "v", also=("label", "is_anchor"))
    spark, kind = vectors.sparkSession, dict(rows.dtypes)["id"]
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    norm = F.expr("aggregate(v, 0L, (s, x) -> s + cast(x as bigint) * x)")
    width, top = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    if width is None:
        return spark.createDataFrame([], schema)
    # A bounded, repeatable choice: the order of hashed ids.
    sample = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(max(PROBES, pivots)).select("id", "label", "v").collect()
    known = Pivots(sample, max(width, 1), top, pivots)

    stored = cut(_cells(rows, known, kind))
    extent = {r.cell: r for r in stored.groupBy("cell").agg(F.min("radius").alias("least"), F.max("radius").alias("most"), F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    asked = cut(_anchors(rows, known, kind, positives))
    joined = _Join(stored, extent, known, kind, group, block)

    def of_label(a: dict, x: dict, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        i, j = np.nonzero((a["label"][:, None] == x["label"][None]) & (a["id"][:, None] != x["id"][None]) & (score >= a["floors"]))
        yield i, j, 0

    found = joined.run(asked, of_label, positives)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    won = cut(first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("won")))

    opened = asked.drop("floors", "ceilings", "near", "far").join(won, asked["id"] == won["anchor"]).drop("anchor")
    windows = cut(_windows(opened, known, kind, negatives, low, high))

    def in_window(a: dict, x: dict, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        other = a["label"][:, None] != x["label"][None]
        for p in range(a["floors"].shape[1]):
            i, j = np.nonzero(other & (score >= a["floors"][:, p : p + 1]) & (score <= a["ceilings"][:, p : p + 1]))
            yield i, j, p

    found = joined.run(windows, in_window, negatives)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    mine = won.withColumn("_w", F.col("won")).select(F.col("anchor").alias("anchor_id"), "_w")
    return kept.join(mine, F.col("anchor") == F.col("anchor_id")).select(
        "anchor_id", F.expr("_w[place].id").alias("positive_id"), F.col("rank"), F.col("id").alias("negative_id"),
        F.expr("_w[place].score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _cells(rows: DataFrame, known: Pivots, kind: str) -> DataFrame:
    """(id, label, v as bytes, no, cell, radius) of every row; no tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = packed(b.column("v").to_pylist(), known.width)
                d = known.radii(v)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("label"), pa.array(to_bytes(v), pa.binary()), b.column("no"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                    names=["id", "label", "v", "no", "cell", "radius"],
                )
        give_back()

    numbered = rows.select("id", "label", "v", F.monotonically_increasing_id().alias("no"))
    return numbered.mapInArrow(run, f"id {kind}, label long, v binary, no long, cell int, radius double")


_REACH = "home int, reach array<double>, floors array<long>, ceilings array<long>, near double, far double"


def _anchors(rows: DataFrame, known: Pivots, kind: str, positives: int) -> DataFrame:
    """(id, label, v, home, reach, floors, ceilings, near, far) of every anchor: its nearest pivot and its distance from
    each, a score that its last positive reaches for sure, and the distances between which its positives lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("id").to_pylist()
                q = packed(b.column("v").to_pylist(), known.width)
                d = known.distances(q)
                same = b.column("label").to_numpy()[:, None] == known.labels[None]
                floor = kth(positives, products(q, known.v), same & known.others(ids), NONE)
                far = np.sqrt(np.maximum((q * q).sum(1) + float(known.top) - 2.0 * floor, 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("label"), pa.array(to_bytes(q), pa.binary()), pa.array(d.argmin(1).astype(np.int32)), pa.array(list(d)), pa.array(floor[:, None].tolist(), pa.list_(pa.int64())), pa.array([[]] * len(q), pa.list_(pa.int64())), pa.array(np.zeros(len(q))), pa.array(far)],
                    names=["id", "label", "v", "home", "reach", "floors", "ceilings", "near", "far"],
                )

    own = rows.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return own.mapInArrow(run, f"id {kind}, label long, v binary, {_REACH}")


def _windows(opened: DataFrame, known: Pivots, kind: str, negatives: int, low: int, high: int) -> DataFrame:
    """The anchors with a floor and a ceiling of the scores of each positive's negatives. The floor is `low` hundredths
    of the positive's score, or what the last negative reaches for sure; a void window has a floor above its ceiling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = unpacked(b.column("v").to_pylist(), known.width)
            won = [[w["score"] for w in x] for x in b.column("won").to_pylist()]
            score, other = products(q, known.v), b.column("label").to_numpy()[:, None] != known.labels[None]
            most = max(map(len, won))
            at = np.array([x + [0] * (most - len(x)) for x in won], np.int64)
            floor, ceiling = -((-low * at) // 100), (high * at) // 100
            for p in range(most):
                void = np.array([len(x) <= p for x in won]) | (floor[:, p] > ceiling[:, p])
                sure = kth(negatives, score, other & (score >= floor[:, p : p + 1]) & (score <= ceiling[:, p : p + 1]), NONE)
                floor[:, p], ceiling[:, p] = np.where(void, 1, np.maximum(floor[:, p], sure)), np.where(void, 0, ceiling[:, p])
            base = ((q * q).sum(1) + float(known.top))[:, None]
            void = floor > ceiling
            far = np.where(void, -1, np.sqrt(np.maximum(base - 2.0 * floor, 0))).max(1)
            near = np.where(void, np.inf, np.sqrt(np.maximum(base - 2.0 * ceiling, 0))).min(1)
            keep = pa.array(~void.all(1))
            own = pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("v"), b.column("home"), b.column("reach"), pa.array(floor.tolist(), pa.list_(pa.int64())), pa.array(ceiling.tolist(), pa.list_(pa.int64())), pa.array(near), pa.array(far)],
                names=["id", "label", "v", "home", "reach", "floors", "ceilings", "near", "far"],
            )
            yield own.filter(keep)

    return opened.select("id", "label", "v", "home", "reach", "won").mapInArrow(run, f"id {kind}, label long, v binary, {_REACH}")


class _Join:
    """Sends stored vectors and anchors to the units where they meet, and joins those exactly."""

    def __init__(self, stored: DataFrame, extent: dict, known: Pivots, kind: str, group: int, block: int):
        self.stored, self.extent, self.known, self.kind, self.group, self.block = stored, extent, known, kind, group, block
        self.blocks = {c: max(1, -(-r.n // block)) for c, r in extent.items()}

    def _groups(self, asked: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
        """home -> group, group -> parts: neighbouring homes together up to `group` anchors; larger ones in parts."""
        held = {r.home: r.n for r in asked.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
        of, size = {}, {}
        apart = self.known.radii(self.known.v[: self.known.n]) if held else None
        rest, at, g = set(held), None, -1
        while rest:
            at = min(rest) if at is None else min(rest, key=lambda h: (apart[at][h], h))
            if g < 0 or size[g] + held[at] > self.group:
                g += 1
                size[g] = 0
            of[at] = g
            size[g] += held[at]
            rest.remove(at)
        return of, {i: max(1, -(-n // self.group)) for i, n in size.items()}

    def run(self, asked: DataFrame, choose: Callable, k: int) -> DataFrame:
        """(anchor, place, id, score): of each unit the k best vectors that `choose` allows to each anchor and place."""
        of, parts = self._groups(asked)
        known, kind = self.known, self.kind
        if not of:
            return asked.sparkSession.createDataFrame([], f"anchor {kind}, place int, id {kind}, score long")
        member = asked.withColumn("g", _lookup("home", of)).withColumn("part", F.pmod(F.xxhash64("id"), _lookup("g", parts)).cast("int"))
        # At which radii of which cell a vector may serve a group: at most a row for each two pivots.
        span = member.select("g", F.posexplode("reach").alias("cell", "d")).groupBy("g", "cell").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
        ring = member.groupBy("g").agg(F.min("near").alias("near"), F.max("far").alias("far"))
        pad = F.lit(SLACK) * (F.col("far") + F.col("d1") + self.known.norm)
        reach = span.join(ring, "g").select(
            "g", F.col("cell"), (F.greatest(F.col("d0") - F.col("far"), F.col("near") - F.col("d1")) - pad).alias("r0"), (F.col("far") + F.col("d1") + pad).alias("r1"), _lookup("g", parts).alias("parts")
        )
        blocked = self.stored.withColumn("block", F.pmod(F.xxhash64("no"), _lookup("cell", self.blocks)).cast("int"))
        served = blocked.join(F.broadcast(reach), "cell").where("radius between r0 and r1")
        vectors = served.select(F.col("g").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("cell").alias("cell"), "block", "id", "label", "v")
        # An anchor goes to the blocks of cells that its own ring cuts.
        cells = asked.sparkSession.createDataFrame([(c, float(r.least), float(r.most), self.blocks[c]) for c, r in sorted(self.extent.items())], "cell int, least double, most double, blocks int")
        own = member.select("*", F.posexplode("reach").alias("cell", "d")).drop("reach").join(F.broadcast(cells), "cell")
        slack = F.lit(SLACK) * (F.col("far") + F.col("d") + self.known.norm)
        own = own.where((F.col("d") - F.col("most") <= F.col("far") + slack) & (F.col("least") - F.col("d") <= F.col("far") + slack) & (F.col("d") + F.col("most") >= F.col("near") - slack))
        anchors = own.select("g", "part", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "label", "v", "floors", "ceilings")
        keys = ["g", "part", "cell", "block"]
        numeric = kind in ("bigint", "int", "smallint", "tinyint")

        def meet(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(x):
                return pd.DataFrame({"anchor": [], "place": [], "id": [], "score": []})
            ids = lambda f: f["id"].to_numpy(np.int64 if numeric else object)
            wide = max(map(len, a["floors"]))
            table = lambda c, gap: np.array([[*r, *[gap] * (wide - len(r))] for r in a[c]], np.int64)
            asked_ = {"id": ids(a), "label": a["label"].to_numpy(), "floors": table("floors", 1), "ceilings": table("ceilings", 0)}
            held = {"id": ids(x), "label": x["label"].to_numpy()}
            score = products(unpacked(a["v"], known.width), unpacked(x["v"], known.width))
            out = []
            for i, j, p in choose(asked_, held, score):
                s = score[i, j]
                at = best(k, i, s, held["id"][j] if numeric else np.unique(held["id"], return_inverse=True)[1][j])
                out.append(pd.DataFrame({"anchor": asked_["id"][i[at]], "place": np.int32(p), "id": held["id"][j[at]], "score": s[at]}))
            return reduce(lambda f, g: pd.concat([f, g]), out)

        return anchors.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInPandas(meet, f"anchor {kind}, place int, id {kind}, score long")


def _lookup(column: str, values: dict[int, int]) -> Column:
    """A number for each value of a column, from at most a few hundred pairs."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), F.col(column))
