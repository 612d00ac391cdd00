"""Tables dealt by key into partitions of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Rows of a partition, about.
ROWS = 200_000


def parts(df: DataFrame, rows: int = ROWS) -> int | None:
    """How many partitions hold about `rows` rows of df each; None where Spark's own number holds them."""
    spark = df.sparkSession
    n = -(-df.count() // rows)
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, n: int | None, *keys: str | Column) -> DataFrame:
    """df with the rows of each key in one of n partitions (see parts): what a task holds does not grow with the table.
    Groups and windows by the keys need no shuffle of their own."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)
