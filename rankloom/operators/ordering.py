"""Row numbers and top-k cuts that never put a whole table into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

_ROW_BITS = 33


def number_within(df: DataFrame, keys: list[str], buckets: list[str], order: list[str] | list[Column], out: str) -> DataFrame:
    """Dense numbers from 1 inside each key, ordered by ``buckets`` then ``order``.

    Rows are numbered inside (key, bucket) and shifted by the sizes of the key's earlier
    buckets, so a key that holds most of the table is still split over many tasks.
    """
    groups = keys + buckets
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(*buckets).rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return (
        df.withColumn("_local", local)
        .join(shifts, groups)
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before")
    )


def number_all(df: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """Dense numbers over the whole table in the given total order.

    Range partitions are sorted on their own and shifted by the sizes of the earlier
    ones. The sorted rows are checkpointed first, so both passes see the same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    placed = placed.withColumn("_part", part).withColumn("_row", F.col("_at") - F.shiftleft(part, _ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range partition: small by construction.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = cut_lineage(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (
        placed.join(F.broadcast(shifts), "_part")
        .withColumn(out, (F.col("_before") + F.col("_row") + start).cast("bigint"))
        .drop("_at", "_part", "_row", "_before")
    )


def top_k(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank", spread: str = "corpus_id", sliced: bool = True) -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1.

    Two levels: a key is first cut to ``k`` in slices, as many as the square root of the
    number of shuffle partitions, and then over its slices. So no task receives the best
    ``k`` rows of every other task for one key. Without ``sliced``, for keys that bring a few lists
    of ``k`` rows each, rows are shuffled once.
    """
    ranked = F.row_number().over(W.partitionBy(key).orderBy(*order))
    if not sliced:
        return df.withColumn(rank, ranked).filter(F.col(rank) <= k)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(2, math.isqrt(partitions))
    of_slice = W.partitionBy(key, "_slice").orderBy(*order)
    df = (
        df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)))
        .withColumn("_rn", F.row_number().over(of_slice))
        .filter(F.col("_rn") <= k)
        .drop("_rn", "_slice")
    )
    return df.withColumn(rank, ranked).filter(F.col(rank) <= k)
