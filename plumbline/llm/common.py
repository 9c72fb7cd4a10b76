"""Pieces that several corpus operators share: shared storage, Arrow access, word and hash helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.batches import slices, small_batches

_own_dirs: dict[str, str] = {}
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where that is unset and all tasks run in this process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own_dirs[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, lost executors lose nothing.

    Spark is asked to delete the write's shuffle files when it is done, since nothing reads them again.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path  # for drop()
    return out


def drop(df: DataFrame) -> None:
    """Delete a stashed table that nothing will read again."""
    path = getattr(df, "_stash_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as bytes objects; nothing is decoded, so malformed UTF-8 cannot fail."""
    col = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return (col if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else col.cast(kind)).to_pylist()


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over bounded slices; fn returns a batch (or None) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def judge_texts(spark: SparkSession, text: Column, judge: Callable[[], Callable[[bytes | None], tuple]], schema: T.StructType) -> Column:
    """A struct for each text by an Arrow UDF, so that a row's other columns stay in the JVM; judge() is called once a task."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = judge()
        kinds = to_arrow_schema(schema)
        for batch in batches:
            parts = []
            for part in slices(pa.RecordBatch.from_arrays([batch], ["text"])):
                rows = [one(t) for t in binary(part, "text")]
                parts.append(pa.StructArray.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], fields=list(kinds)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(kinds)))
            pa.default_memory_pool().release_unused()

    small_batches(spark)
    # Marked so that no filter on the result makes Spark run it twice.
    return F.arrow_udf(run, schema).asNondeterministic()(text.cast("binary"))


_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(name: str) -> Column:
    """A column of a caller's table, whatever its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """A caller's row as one struct, so that its names cannot meet an operator's own."""
    return F.struct(*[col(c) for c in df.columns])


def fields(row: str, names: list[str]) -> list[Column]:
    """Columns of a whole_row, taken out again."""
    return [F.col(row).getField(c).alias(c) for c in names]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())


WORD = r"[^\x20\x09-\x0D]+"
LETTER = re.compile(r"[^\W\d_]")

_B = np.uint64(0x9E3779B97F4A7C55)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, grown on demand."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_B, _B_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of symbols[j] * B**j for j < i; feeds window_hash."""
    p = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=p[1:])
    return p


def window_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all windows of n symbols: one subtraction and one product each."""
    m = len(prefix) - n
    if m <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[n:] - prefix[:m]) * powers(m)[1])


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Boolean mask of the positions inside any [start, start + n)."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0
