"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

# Texts are taken from an Arrow batch in slices of about this many bytes.
SLICE_BYTES = 4 * 1024 * 1024
# Entries of a worker's word cache; a full cache is emptied.
CACHE_ENTRIES = 400_000
# The same where an entry costs a hash only.
HASH_ENTRIES = 100_000

_KEPT: dict[tuple, object] = {}


def kept_in_worker(name: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task.

    Spark goes on with the same workers in later stages, so what another operator left is
    dropped first: a worker holds one operator's caches at a time.
    """
    if name not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # only some C libraries can give memory back
                ctypes.CDLL(None).malloc_trim(0)
        _KEPT[name] = make()
    return _KEPT[name]


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did."""
    root = str(Path(__file__).resolve().parent.parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = root + (os.pathsep + paths if paths else "")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], *columns: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size by these columns, or ``text`` (a single longer row stays whole)."""
    columns = columns or ("text",)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * size / max(1, sum(batch.column(c).nbytes for c in columns))))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null texts count as empty."""
    return [value or "" for value in batch.column(name).to_pylist()]


def replaced(batch: pa.RecordBatch, name: str, values) -> pa.RecordBatch:
    """The batch with one column's values replaced, in place and of the same type."""
    at = batch.schema.get_field_index(name)
    columns = [pa.array(values, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def row_key() -> list[Column]:
    """Two columns that tell rows of ``(doc_id, text)`` apart, null ids included.

    Rows that agree in both columns have equal ids and equal texts.
    """
    return [
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("key_id"),
        F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("key_text"),
    ]
