"""Helpers that the training-data operators share: scratch tables, Arrow text buffers, pass-through columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The five columns of the `documents` table; the pipeline's stages hand them on.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of rows that go to a Python worker together, about; one row at least. The rows together make no difference to any result.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

#: Bytes of a row group of what `materialize` writes: writers hold one, and readers a column of one, in memory.
ROW_GROUP = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster shares between driver and executors (`spark.checkpoint.dir`).

    Only where that is unset on one machine, as in a test, a temporary folder is made and put there; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/lexspan/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor
    costs the tasks that read it, not the work behind it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Has batches of rows go to Python workers in BATCH_BYTES, unless the session says how many. Spark's own bounds are 10,000 rows and
    64 MB, and the executor's JVM, which keeps much of what it has had for buffers, and both of its workers hold several at a time."""
    if not spark.conf.get(BATCH_CONF, None):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def carried(df: DataFrame, keep: Sequence[str], made: Sequence[str]) -> list[T.StructField]:
    """The fields of the columns to carry along; a name that the operator makes itself can't be carried."""
    if clash := sorted(set(keep) & set(made)):
        raise ValueError(f"columns {clash} are made by the operator; rename them before carrying them along")
    return [df.schema[c] for c in keep]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return at.astype(np.int64), raw


def text_slices(column: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8 bytes; a null is empty."""
    at, raw = utf8(column)
    view = memoryview(raw)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield bytes(view[a:b])


def runs(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


def batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def arrow_schema(fields: Sequence[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType(list(fields)))


def give_back() -> None:
    """Hands memory that this process has freed back to the system: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What this Python worker remembers from task to task, by a name for each kind of thing.
remembered: dict[str, dict] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function for mapInArrow that gives memory back when the task ends, however it ends. What tasks of other kinds than
    `keep` have left in the worker goes before it begins."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in remembered.keys() - {keep}:
            del remembered[name]
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
