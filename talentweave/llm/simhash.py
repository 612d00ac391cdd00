"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share one: the
middle of their way. Fingerprints that share a variant are each within half the radius of it, hence linked; a variant
has at most as many as the ball has points (65 for radius 2), so no group grows with the data. Rows of a variant link
to its smallest fingerprint, the links are deduplicated and verified, and components come from rounds of contraction
whose state is written to the shared folder.

Texts: A-Z lower-cased, words between white space `[\\x20\\x09-\\x0D]`, shingles of `size` words with repeats; fewer
words are one shingle; none (or a null text) give fingerprint 0, linked like any other. Repeated rows share a
component; ids may repeat; a null id never names a component unless its component has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.llm.common import add_columns, cut

SHINGLE, SEED, RADIUS = 3, 42, 2
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CHUNK = 100_000


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(b" ".join(words), SEED)]
    if size == 3:
        return [h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    return [h(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)]


def fingerprints_of(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """Bit j is set where over half of a text's hashes have it."""
    hashes = [shingle_hashes(t, size) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.array([x for h in hashes for x in h], "<u8")
    row = np.repeat(np.arange(len(texts)), n)
    ones = np.zeros((len(texts), 64), np.int64)
    for i in range(0, len(flat), _CHUNK):
        bits = np.unpackbits(flat[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = row[i : i + _CHUNK]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        ones[of[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SHINGLE, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the 64 bits of each text's fingerprint as a long."""
    return add_columns(df, text, T.StructType().add(out, T.LongType()), lambda: lambda column: [pa.array(fingerprints_of(column.to_pylist(), size))], drop)


def hex_digits(c: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))


def links(fps: DataFrame, radius: int = RADIUS, column: str = "fp") -> DataFrame:
    """(a, b), a > b: a star of links for each variant that distinct fingerprints share; together they connect
    whatever is within the radius. The radius is even, so that all who share a variant are within it."""
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be even and positive")
    masks = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(64), k)]
    signed = ",".join(f"{m - (1 << 64) if m >> 63 else m}L" for m in masks).replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
    variants = fps.select(F.col(column).alias("a"), F.explode(F.expr(f"transform(array({signed}), m -> {column} ^ m)")).alias("variant"))
    # The ball's size bounds the rows of a variant, and so these windows.
    shared = variants.selectExpr("a", "min(a) over (partition by variant) as b").where("a > b")
    return shared.where(f"bit_count(a ^ b) <= {radius}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node of its component.

    In a round every node takes the smallest of itself and its neighbours as parent, follows parents a few steps, and
    links are replaced by links between parents; this goes on until none is left. Minima are pre-aggregated and joins
    on a hub are split by AQE, so no task holds a component.
    """
    edges = cut(edges.select("a", "b").where("a <> b"))
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("parent"))
        for _ in range(2):
            parent = cut(parent)
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            parent = parent.join(up, "parent").select("node", F.col("top").alias("parent"))
        parent = cut(parent)
        a, b = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(a, "a").join(b, "b").where("pa <> pb").selectExpr("greatest(pa, pb) as a", "least(pa, pb) as b")
        edges = cut(moved.distinct())
        if roots is None:
            roots = parent.withColumnRenamed("parent", "root")
        else:
            up = parent.select(F.col("node").alias("root"), F.col("parent").alias("top"))
            roots = cut(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, fingerprint, component_id, root) of every row, and its columns `also`. component_id: the smallest key
    reachable over links, itself included; root: the component's smallest fingerprint, which tells components apart
    where keys are null or repeat."""
    fp = next(n for n in ("fp", "fp_", "fp__") if n not in (key, *also))
    own = cut(fingerprint(df.select(F.col(key), F.col(text), *also), text, fp, size, drop=(text,)))
    groups = cut(own.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")))
    roots = components(links(groups.select("fp"), radius))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(named, "root").select(F.col("fp").alias(fp), "component_id", "root"))
    return own.join(named, fp).select(key, F.col(fp).alias("fingerprint"), "component_id", "root", *also)
