"""A chunk store that follows a folder of documents: only the parts of changed files are written again.

Files belong to parts by a hash of their name, and the store is partitioned by part. An update compares the manifest of
the last build with the present one, builds the parts of added, changed and removed files from those parts' files, and
replaces them by a dynamic partition overwrite; the manifest is written last. A run that ends early leaves the old
manifest, so the next one builds the same parts again, from the files and not from the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.operators.evaluation import manifest_changes

#: Parts of a store; about as many as files are expected to change at once, or more.
PARTS = 256


def part_of(name: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")


def known_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha1) of the files that the store holds; none where there is no store yet."""
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "name string, sha1 string")


def update(spark: SparkSession, path: str, manifest: DataFrame, read: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> DataFrame:
    """Brings the store up to date with a manifest (name, sha1) and returns (name, change, part) of the files that differ.

    read gives the rows of some files, a column `name` among them, from a table (name, sha1, part); it is called with all
    files of the parts that are built. Nothing is written where nothing differs. The number of parts must stay the same
    for a store.
    """
    now = manifest.select("name", "sha1").where("name is not null").groupBy("name").agg(F.min("sha1").alias("sha1"))
    differ = manifest_changes(known_manifest(spark, path), now).where("change <> 'unchanged'").withColumn("part", part_of(F.col("name"), parts))
    # The difference is kept before the manifest that it rests on is replaced; a row for each changed file.
    differ.write.mode("overwrite").parquet(f"{path}/changes")
    differ = spark.read.schema(differ.schema).parquet(f"{path}/changes")
    if differ.isEmpty():
        return differ
    touched = differ.select("part").distinct()
    files = now.withColumn("part", part_of(F.col("name"), parts)).join(touched, "part", "left_semi")
    rows = read(files).withColumn("part", part_of(F.col("name"), parts))
    # A row without a name stands for a part, which is replaced even if nothing is left in it.
    marked = rows.unionByName(touched, allowMissingColumns=True)
    marked.repartition("part", "name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/rows")
    now.write.mode("overwrite").parquet(f"{path}/manifest")
    return differ


def rows(spark: SparkSession, path: str) -> DataFrame:
    """What the store holds, without the column of parts."""
    return spark.read.parquet(f"{path}/rows").where("name is not null").drop("part")
