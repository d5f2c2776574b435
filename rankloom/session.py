"""Session-level helpers: shared scratch space, lineage cuts and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only after it was measured to be below both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = root + (os.pathsep + paths if paths else "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as ``spark.checkpoint.dir`` names it.

    A session of one machine that names none (a unit test) gets one of its own. On a
    cluster there is no such default: executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never used twice."""
    return f"{shared_dir(spark)}/rankloom/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries inside the block shuffled is deleted when they end, not when the driver collects its garbage.

    For queries whose result is written or collected: nothing reads their shuffle files again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and go on from there.

    Later jobs survive a lost executor without recomputing what came before, and Spark
    knows the size of what it reads back, so it plans the next joins by it.
    """
    path = scratch_path(df.sparkSession, "step")
    for steps in _RECORDERS:
        steps.append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_step(df: DataFrame) -> None:
    """Delete the step that ``cut_lineage`` returned as ``df``; no frame may read it from then on."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for step in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if step.rsplit("/", 1)[1].startswith("step-"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(step)
            path.getFileSystem(hadoop).delete(path, True)


_RECORDERS: list[list[str]] = []


@contextmanager
def recorded_steps() -> Iterator[list[str]]:
    """The paths of the steps that are written inside the block."""
    steps: list[str] = []
    _RECORDERS.append(steps)
    try:
        yield steps
    finally:
        _RECORDERS.remove(steps)


def drop_steps(spark: SparkSession, steps: list[str], still_read: DataFrame) -> list[str]:
    """Delete written steps that ``still_read`` does not read; those it reads are returned."""
    files = still_read.inputFiles()
    kept = [step for step in steps if any(step.rsplit("/", 1)[1] in file for file in files)]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for step in steps:
        if step not in kept:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(step)
            path.getFileSystem(hadoop).delete(path, True)
    return kept


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores is dealt out to all of them.

    That is a shuffle of a small input only: a large one has more splits and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _width(field: T.StructField):
    """Bytes a column of this type needs per row, as an expression."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        element = field.dataType.elementType
        if isinstance(element, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(col, "")), F.lit(0)) + 8 * F.coalesce(F.size(col), F.lit(0))
        return 8 * F.greatest(F.size(col), F.lit(0))
    return F.lit(8)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure rows and bytes; reads at most ``max_rows + 1`` rows."""
    width = F.lit(16)
    for field in df.schema.fields:
        width = width + _width(field)
    # Only the widths meet in one task, not the rows.
    row = (
        df.select(width.cast("bigint").alias("w")).limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b"))
        .first()
    )
    return row["n"] <= max_rows and row["b"] <= max_bytes
