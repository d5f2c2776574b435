"""Bloom filters made and asked with DataFrame functions.

A filter is a bitmap of 64-bit words in a one-row table. Asking it is a scalar subquery in
the scan, so nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

# Bits per key and bits set per key: of a first filter, and of the later ones of a cascade.
FIRST, LATER = (10, 4), (4, 2)
# Words of one filter at most: 8 MB.
MAX_WORDS = 1 << 20


def words_for(count: int, level: int = 0) -> int:
    return max(1, -(-count * (LATER if level else FIRST)[0] // 64))


class Filter:
    """One level: a bitmap in a one-row table, and how to ask it."""

    def __init__(self, bitmap: DataFrame, words: int, level: int, probes: int):
        self.bitmap, self.words, self.level, self.probes = bitmap, words, level, probes

    @staticmethod
    def places(key: Column, words: int, level: int, probes: int) -> list[Column]:
        first, step = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
        # Both parts are below 2^31, so their sums cannot overflow.
        part, stride = F.pmod(first, F.lit((1 << 31) - 1)), F.pmod(step, F.lit((1 << 31) - 1))
        return [F.pmod(part + i * stride, F.lit(64 * words)) for i in range(probes)]

    @classmethod
    def build(cls, keys: DataFrame, count: int, level: int = 0) -> Filter:
        """Of the column ``key``."""
        words, probes = words_for(count, level), (LATER if level else FIRST)[1]
        spots = keys.select(F.explode(F.array(*cls.places(F.col("key"), words, level, probes))).alias("spot"))
        bit = F.expr("shiftleft(1L, CAST(spot % 64 AS INT))")
        filled = spots.groupBy(F.floor(F.col("spot") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
        every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"))
        dense = every.join(filled, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("w"))
        # One row of at most MAX_WORDS words.
        bitmap = dense.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("bitmap"))
        return cls(cut_lineage(bitmap), words, level, probes)

    def accepts(self, key: Column) -> Column:
        bitmap = self.bitmap.scalar()
        hits = None
        for spot in self.places(key, self.words, self.level, self.probes):
            word = F.get(bitmap, F.floor(spot / 64).cast("int"))
            hit = F.getbit(word, F.pmod(spot, F.lit(64)).cast("int")) == 1
            hits = hit if hits is None else hits & hit
        return hits


def holding(df: DataFrame, keys: DataFrame, key: Column, keys_key: Column) -> tuple[Filter | None, DataFrame]:
    """A filter of the keys, or None where it would be too large, and the rows of ``df`` that may be among them."""
    distinct = cut_lineage(keys.select(keys_key.alias("key")).distinct())
    count = distinct.count()
    if words_for(count) > MAX_WORDS:
        return None, df
    made = Filter.build(distinct, count)
    return made, df.filter(made.accepts(key))
