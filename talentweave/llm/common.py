"""What the training-data operators share: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at a time inside a Python worker; one longer document makes a slice of its own.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. A local
    session without either gets a temporary one; on a cluster, whose executors would not see that, it is an error."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        place = sc.getCheckpointDir()
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later plans start from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes what cut() has written in this application; call it once results that rest on it are stored."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose `column` holds about SLICE_BYTES, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        yield batch.slice(start)


def add_columns(df: DataFrame, column: str, new: T.StructType, work: Callable[[], Callable[[pa.Array], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns computed from one string (or array) column by Arrow slices; the other columns pass through.

    work() runs once in each Python worker's task and returns the function of a slice. New columns replace those of
    the same name.
    """
    gone = {*drop, *(f.name for f in new)}
    kept = [(f"c{i}", f) for i, f in enumerate(df.schema) if f.name not in gone]
    # Numbered names inside: Python rows are read by plain names, which those with dots and ticks are not.
    result = [*(f for _, f in kept), *new]
    schema = T.StructType([T.StructField(f"r{i}", f.dataType) for i, f in enumerate(result)])
    source = [c for c, _ in kept]
    own = f"c{df.columns.index(column)}"
    binary = isinstance(df.schema[column].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        try:
            for part in sliced(batches, own) if binary else batches:
                if not part.num_rows:
                    continue
                at = part.schema.get_field_index
                made = do(part.column(at(own)))
                yield pa.RecordBatch.from_arrays([*(part.column(at(c)) for c in source), *made], names=schema.names)
        finally:
            del do
            give_back()

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema).toDF(*(f.name for f in result))


def give_back() -> None:
    """Returns a Python worker's free memory to the system at a task's end: workers are kept for later stages, whose
    own needs would come on top."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text") -> list[tuple[object, int, str]]:
    """Id, label and text of at most `bound` labelled documents of each class, in the order of hashed ids. Repeated
    label rows count once, with the largest value; of rows that share an id the least text counts."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    order = (F.xxhash64(F.col(key)), F.col(key))
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(bound) for y in (0, 1)]
    # At most 2 * bound rows are broadcast, and as many come back.
    picked = docs.select(F.col(key), text_or_empty(text).alias("own")).join(F.broadcast(chosen[0].union(chosen[1])), key)
    rows = picked.groupBy(F.xxhash64(F.col(key)).alias("h"), key, "y").agg(F.min("own").alias("own")).collect()
    return [(r[1], r[2], r[3]) for r in sorted(rows)]


#: Odd numbers of a multiplicative hash.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of each 64-bit number; no two numbers give the same."""
    x = x * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
