"""Arrow batches of bounded size for Python, whatever the length of rows and however many rows a task has."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 2000


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Batches for Python of a bounded size, whatever the length of rows, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(size))


def slices(batch: pa.RecordBatch, rows: int = 2000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Bounded pieces of a batch, by rows and bytes (or one row), so that working arrays stay small."""
    kinds = (pa.string(), pa.binary(), pa.large_string(), pa.large_binary())
    lengths = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if c.type in kinds), np.zeros(batch.num_rows, np.int64))
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def packed(rows: Iterable[tuple], schema: pa.Schema, most: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as batches, each sent as soon as it is full."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


def flat_map(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """The rows that fn makes of a partition's rows; neither side is held beyond a bounded batch (or one row)."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch):
                yield from zip(*(column.to_pylist() for column in part.columns))
            pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: packed(fn(each(batches)), schema), ddl)
