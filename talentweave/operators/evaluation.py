"""Agreement of extractors in long form, from rows (entity, field, system, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions import text as X


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, else the share of common items, to four places."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 4))


def first_missing(a: Column, b: Column, most: int = 20) -> Column:
    """Items of a that b lacks, sorted, the first few."""
    return F.slice(F.sort_array(F.array_except(a, b)), 1, most)


_OF = ("entity", "field")


def holders(items: DataFrame) -> DataFrame:
    """(entity, field, item, systems): the systems that have each normalised item of rows (entity, field, system, item);
    a null item has those with rows of null or empty items. A list is as long as there are systems at most; no row holds
    an entity's items."""
    item = F.nullif(X.plain_norm(F.col("item")), F.lit(""))
    # Repeated items go before they are normalised.
    return items.select(*_OF, "system", "item").distinct().select(*_OF, "system", item.alias("item")).groupBy(*_OF, "item").agg(F.sort_array(F.collect_set("system")).alias("systems"))


def patterns(items: DataFrame, first: int = 0) -> DataFrame:
    """(entity, field, systems, n, items): for each set of systems that some item of rows (entity, field, system, item) has
    exactly, how many items that are, and the `first` of them. Few rows, however many items there are."""
    of = holders(items)
    counts = of.groupBy(*_OF, "systems").agg(F.count("item").alias("n"))
    none = F.array().cast("array<string>")
    if not first:
        return counts.withColumn("items", none)
    # Nulls go last and are not collected: a filter would reach the scan, and the items would be grouped twice.
    order = Window.partitionBy(*_OF, "systems").orderBy(F.asc_nulls_last("item"))
    some = of.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first)
    lists = some.groupBy(*_OF, "systems").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return counts.join(lists, [*_OF, "systems"], "left").withColumn("items", F.coalesce("items", none))


def compare(items: DataFrame, differences: int = 20) -> DataFrame:
    """A row for each pair of systems of an entity and field in rows (entity, field, system, item): sizes, Jaccard, and
    the first `differences` items that one has and the other lacks. Items of a null or empty text are none; a system
    with no item has an empty set, and two of them are alike (1).

    Items are grouped once, then sets of systems stand for all items that they have: pairs meet those few rows."""
    of = patterns(items, differences)
    systems = of.select(*_OF, F.explode("systems").alias("system_a")).distinct()
    pairs = systems.join(systems.withColumnRenamed("system_a", "system_b"), [*_OF]).where("system_a < system_b")
    a, b = (F.array_contains("systems", F.col(c)) for c in ("system_a", "system_b"))
    total = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    few = lambda hit: F.slice(F.array_sort(F.flatten(F.collect_list(F.when(hit, F.col("items"))))), 1, max(differences, 1))
    found = pairs.join(of, [*_OF]).groupBy(*_OF, "system_a", "system_b").agg(total(a & b).alias("_both"), total(a).alias("_na"), total(b).alias("_nb"), few(a & ~b).alias("a_minus_b"), few(b & ~a).alias("b_minus_a"))
    union = F.col("_na") + F.col("_nb") - F.col("_both")
    lists = ["a_minus_b", "b_minus_a"] if differences else []
    return found.select(*_OF, "system_a", "system_b", F.col("_na").cast("int").alias("size_a"), F.col("_nb").cast("int").alias("size_b"), F.when(union == 0, F.lit(1.0)).otherwise(F.round(F.col("_both") / union, 4)).alias("jaccard"), *lists)


def winners(items: DataFrame) -> DataFrame:
    """(entity, field, winner, union_count): the system with most items, the first by name at a tie."""
    of = patterns(items)
    sizes = of.select(*_OF, "n", F.explode("systems").alias("system")).groupBy(*_OF, "system").agg(F.sum("n").alias("n"))
    best = sizes.groupBy(*_OF).agg(F.min_by("system", F.struct(-F.col("n"), "system")).alias("winner"))
    return best.join(of.groupBy(*_OF).agg(F.sum("n").cast("int").alias("union_count")), [*_OF])


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change) of files (name, sha1): added, removed, changed or unchanged."""
    both = old.select("name", F.col("sha1").alias("_o")).join(new.select("name", F.col("sha1").alias("_n")), "name", "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed").otherwise("unchanged")
    return both.select("name", change.alias("change"))
