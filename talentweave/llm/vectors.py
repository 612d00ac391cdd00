"""Integer vectors of the nearest-neighbour operators: preparing, packing and exact inner products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are clamped to this size: a hundred times an inner product of 4,096 of them still fits a long.
CLAMP = 1 << 22
#: A product of doubles is exact as long as every sum stays below this.
EXACT = float(1 << 53)


def integers(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, *also, v): each component x of a vector as floor(scale * x), x as double, clamped to +-2^22.

    Rows without an id, a vector, or with a component that is null, NaN or infinite take no part. Repeated rows stay, each
    as a row of its own. Columns that are not named here, whatever they are called, go.
    """
    own = df.select(F.col(id_col).alias("id"), *also, F.col(vector).alias("v"))
    sound = "v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    floor = f"cast(greatest({-CLAMP}, least({CLAMP}, floor({scale}D * cast(x as double)))) as int)"
    return own.where(F.col("id").isNotNull() & F.expr(sound)).withColumn("v", F.expr(f"transform(v, x -> {floor})"))


def packed(values: list | np.ndarray, width: int) -> np.ndarray:
    """Vectors as rows of int64; shorter ones are filled up with zeros."""
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def unpacked(blobs, width: int) -> np.ndarray:
    """The int32 vectors of a column of bytes as rows of int64."""
    return np.frombuffer(b"".join(blobs), dtype="<i4").reshape(-1, width).astype(np.int64)


def to_bytes(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows.astype("<i4")]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of a and rows of b, exact: by doubles where every sum is below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the k first entries of each group, by score from above, then by id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < k]


def kth(k: int, scores: np.ndarray, allowed: np.ndarray, none: int) -> np.ndarray:
    """Of each row the k-th largest allowed score, or `none` where fewer are allowed."""
    held = np.where(allowed, scores, none)
    if held.shape[1] < k:
        return np.full(len(held), none, np.int64)
    return np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
