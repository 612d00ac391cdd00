"""A stream of records that are upserted by key: a sink for foreachBatch that may run a batch twice.

Each micro-batch is stored as a partition of its own, named by its id and overwritten if the batch runs again, so a replay
after a failure changes nothing. What a key's record is follows from all batches: the latest row of the latest batch that
has the key. Compaction folds the batches so far into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talentweave.sources import scratch


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Stores a micro-batch, in place of an earlier run of the same one."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream's batches below `path`. checkpoint: where the stream keeps how far it has come; with `once` it ends
    when all that is there has been read."""
    writer = stream.writeStream.foreachBatch(lambda batch, n: write_batch(batch, n, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(batches: DataFrame, key: list[str], order: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """The record of each key from rows with a column `batch`: of the latest batch that has the key the row with the
    largest `order`, null last, then the largest in its columns' order. Columns in keep_old take the last value that is
    not null, of the row that counts in each batch. A null key is a key."""
    rest = [c for c in batches.columns if c not in (*key, "batch")]
    row = F.struct(F.col(order).isNotNull().alias("_there"), F.col(order).alias("_order"), *rest)
    each = batches.groupBy(*key, "batch").agg(F.max(row).alias("r"))
    pick = lambda c: F.max(F.when(F.col(f"r.{c}").isNotNull(), F.struct("batch", f"r.{c}")))[c] if c in keep_old else F.max_by(f"r.{c}", "batch")
    return each.groupBy(*key).agg(*[pick(c).alias(c) for c in rest])


def current(spark: SparkSession, path: str, key: list[str], order: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """The records after all batches that are stored."""
    return latest(spark.read.parquet(path), key, order, keep_old)


def compact(spark: SparkSession, path: str, key: list[str], order: str, keep_old: tuple[str, ...] = ()) -> int:
    """Folds the batches so far into the latest of them and empties the others; returns its id. Run it between a stream's
    runs. It may end early: what it has written gives the same records beside what it has not removed."""
    held = spark.read.parquet(path)
    last = held.agg(F.max("batch")).first()[0]
    folded = scratch.written(latest(held, key, order, keep_old))
    write_batch(folded.select([c for c in held.columns if c != "batch"]), last, path)
    # A row for each batch that was stored.
    for r in held.select("batch").distinct().where(F.col("batch") < last).collect():
        write_batch(folded.limit(0), r.batch, path)
    return last
