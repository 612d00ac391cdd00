"""Sequential folds over the rows of a document, many documents to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(df: DataFrame, run: Callable[[list[dict]], list[dict]], schema: T.StructType, order: tuple[str, ...] = ("line_no",), by: str = "doc_id") -> DataFrame:
    """run over each document's rows, in order, as one list; what it returns are the rows of the result.

    Rows are dealt by document and sorted inside the partition, so that a task streams through them and holds one batch
    and one document at a time.
    """
    arrow = to_arrow_schema(schema)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        out = [r for _, group in groupby(rows, key=lambda r: r[by]) for r in run(list(group))]
        return pa.RecordBatch.from_pylist(out, schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # the rows so far of the document that may go on in the next batch
        for b in batches:
            rows = b.to_pylist()
            if not rows:
                continue
            cut = len(rows)
            while cut and rows[cut - 1][by] == rows[-1][by]:
                cut -= 1
            if cut or (held and held[-1][by] != rows[-1][by]):
                yield batch(held + rows[:cut])
                held = rows[cut:]
            else:
                held += rows
        if held:
            yield batch(held)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(work, schema)


def columns(df: DataFrame, *names: str, **more: T.DataType) -> T.StructType:
    """The schema of some columns of df, and of new ones."""
    return T.StructType([*(df.schema[n] for n in names), *(T.StructField(n, t) for n, t in more.items())])
