"""Joins whose keys may hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut_lineage, fits

# Rows of one key that meet in one task; a key with more is dealt to slices.
SLICE_ROWS = 10_000


def dealt_join(many: DataFrame, few: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """``many.join(few, keys, how)``, with no key's rows of ``many`` in one task.

    The rows of a key with more than ``SLICE_ROWS`` are dealt to slices by the hash of
    ``spread``, and the rows of ``few`` with that key are repeated for each slice. There are
    at most as many such keys as ``many`` has rows divided by ``SLICE_ROWS``.
    """
    slices = F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("_slices")
    hot = cut_lineage(many.groupBy(*keys).agg(slices).filter("_slices > 1"))
    if hot.isEmpty():
        return many.join(few, keys, how)
    known = F.broadcast(hot) if fits(hot) else hot
    one = F.coalesce("_slices", F.lit(1))
    left = many.join(known, keys, "left").withColumn("_slice", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_slices")
    right = few.join(known, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), one - 1))).drop("_slices")
    return left.join(right, [*keys, "_slice"], how).drop("_slice")
