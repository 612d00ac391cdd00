"""Fuzzy joins that meet on q-grams instead of pairing everything.

If the shorter of two strings, of m characters, has a partial ratio of at least c with the longer one, at most
e = m - ceil(m * c / 100) of its characters are left out and as many put in. Each change spoils at most 2q - 1 of its
q-grams together, so any (2q - 1) * e + 1 of them hold one that the longer string has too. The rarest of them are sent to
an inverted index of the longer strings' q-grams; of what meets there, pairs with too few common q-grams go, and the rest
is scored. Each string uses the largest q that its length allows (1 always works), so no cutoff above 0 loses a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions import fuzzy
from talentweave.sources.scratch import written

#: Lengths of grams, the most telling first.
SIZES = (3, 2, 1)


def grams(x: str, q: str) -> str:
    """SQL of the q-grams of a string in order."""
    return f"if(length({x}) >= {q}, transform(sequence(1, length({x}) - {q} + 1), i -> substring({x}, i, {q})), cast(array() as array<string>))"


def _planned(df: DataFrame, c: str, cutoff: float) -> DataFrame:
    """df with the changes e that the cutoff allows a string, its gram length q and its grams."""
    m = F.length(c)
    e = m - F.ceil(m * F.lit(float(cutoff)) / 100 - F.lit(1e-9)).cast("int")
    df = df.withColumn("e", e)
    q = F.coalesce(*[F.when(m - q + 1 >= (2 * q - 1) * F.col("e") + 1, F.lit(q)) for q in SIZES], F.lit(1))
    return df.withColumn("q", q).withColumn("grams", F.expr(grams(c, "q")))


def _indexed(df: DataFrame, c: str) -> DataFrame:
    """(c, gram) of every distinct gram of each string, of all lengths."""
    every = F.expr(f"array_distinct(concat({', '.join(grams(c, str(q)) for q in SIZES)}))")
    return df.select(c, F.explode(every).alias("gram"))


def candidates(short: DataFrame, long: DataFrame, cutoff: float, strict: bool) -> DataFrame:
    """(a, b): pairs of a string a of `short` and one at least as long (longer, if strict) of `long` that can reach the
    cutoff. Both are single columns of distinct strings, a and b."""
    if cutoff <= 0:
        raise ValueError("a cutoff of 0 or less lets every pair through")
    # Read twice, and of a size that shows, unlike that of an exploded table: it is not broadcast by mistake.
    index = written(_indexed(long, "b"))
    common = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A string longer than all of the other side has no partner there.
    most = long.agg(F.max(F.length("b"))).scalar()
    short = short.where((F.length("a") > 0) & (F.length("a") < most if strict else F.length("a") <= most))
    planned = _planned(short, "a", cutoff)
    own = planned.select("a", "e", "q", F.posexplode("grams").alias("pos", "gram")).join(common, "gram", "left")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.coalesce("n", F.lit(0)), "pos"))
    probes = own.withColumn("r", rank).where(F.col("r") <= (2 * F.col("q") - 1) * F.col("e") + 1).where("n is not null").select("a", "e", "q", "gram").distinct()
    longer = F.length("b") > F.length("a") if strict else F.length("b") >= F.length("a")
    met = probes.join(index, "gram").where(longer).select("a", "e", "q", "b").distinct()
    shared = F.expr(f"size(array_intersect({grams('a', 'q')}, {grams('b', 'q')})) >= size(array_distinct({grams('a', 'q')})) - (2 * q - 1) * e")
    return met.where(shared).select("a", "b")


def partial_ratio_join(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, score): all pairs of a string of left (its only column) and one of right whose partial ratio reaches the
    cutoff. Null and empty strings match nothing; repeated ones count once."""
    a = left.toDF("a").where("a <> ''").distinct()
    b = right.toDF("b").where("b <> ''").distinct()
    flipped = candidates(b.toDF("a"), a.toDF("b"), cutoff, strict=True).select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = candidates(a, b, cutoff, strict=False).unionByName(flipped)
    return pairs.withColumn("score", fuzzy.partial_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= cutoff)

