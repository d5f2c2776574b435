"""Source divergence audit: word frequencies of each source against its language.

Two passes over the texts. The first counts in how many documents of a language a term
occurs and keeps the terms above a bound, exactly. The kept terms of a language are dealt
to shards of bounded size, and a minimal perfect hash is built for each: a seed per bucket
of keys sends every key to a slot of its own. The second pass counts all occurrences with
those hashes, broadcast in waves of bounded size: a term that is not kept would also get a
slot, so the key stored there is compared before the slot of the document's group is
incremented. Groups are dense arrays of slots.

Frequencies are whole numbers of a billionth, smoothed, and compared without rounding.

Defined results: null text, language or source is the empty string; a text without a term
counts for its group; an empty table gives no rows; repeated rows count as often as they
occur; equal values rank by item in UTF-8 order; texts of any length are read whole; extra
columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import slices
from rankloom.session import cut_lineage

MIN_DOCS = 30
TOP = 50
SCALE, SMOOTHING = 1_000_000_000, 5
# Keys of one perfect hash on average, and keys of one of its buckets.
SHARD_KEYS, BUCKET_KEYS = 50_000, 4
# Bytes of the perfect hashes that tasks are given at once; more go in further waves.
WAVE_BYTES = 32 * 1024 * 1024
# Terms a task counts before it passes the counts on, and slots it holds.
HELD_TERMS, HELD_SLOTS = 250_000, 4_000_000
# Slots and sources that meet in one block of the comparison.
SLOT_BLOCK, SOURCE_BLOCK = 4096, 64
# Letters A-Z in lower case, other ASCII letters and all bytes above as they are, the rest blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_GROUP = ["lang", "source"]


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def grouped_texts(docs: DataFrame) -> DataFrame:
    """``(lang, source, text)`` without nulls."""
    return docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in (*_GROUP, "text")])


def kept_terms(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term)`` of terms in at least ``min_docs`` documents of the language."""

    def counted(held: dict[str, Counter]):
        for lang, counts in held.items():
            if counts:
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                numbers = pa.array(np.fromiter(counts.values(), np.int64, len(counts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), terms, numbers], ["lang", "term", "n"])
        held.clear()

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from counted(held)
        yield from counted(held)

    partial = texts.select("lang", "text").mapInArrow(run, "lang string, term string, n bigint")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return digests[:, 0], digests[:, 1]


def _mixed(second: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """A slot for a key under a seed; other seeds give unrelated slots."""
    mixed = second ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for _ in range(2):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def _buckets_of(first: np.ndarray, buckets: int) -> np.ndarray:
    return ((first >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def perfect_hash(keys: list[bytes]) -> np.ndarray:
    """Seeds, one per bucket, of a minimal perfect hash of distinct keys.

    Buckets with more keys are placed first. A seed of 0 or more is tried out; a bucket of
    one key names its slot instead, as -1 - slot, so that the last free slots need no search.
    """
    n = len(keys)
    first, second = key_hashes(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    bucket_of = _buckets_of(first, buckets)
    sizes = np.bincount(bucket_of, minlength=buckets)
    by_bucket, starts = np.argsort(bucket_of, kind="stable"), np.cumsum(sizes) - sizes
    seeds, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
    order = np.argsort(-sizes, kind="stable").tolist()
    for bucket in order:
        size = int(sizes[bucket])
        if size < 2:
            break
        group = second[by_bucket[starts[bucket] : starts[bucket] + size]]
        tried, width = 0, 16
        while True:
            slots = np.sort(_mixed(group[None, :], np.arange(tried, tried + width)[:, None], n), axis=1)
            fits = ~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
            if fits.any():
                break
            tried, width = tried + width, min(4096, width * 2)
        at = int(np.argmax(fits))
        seeds[bucket] = tried + at
        taken[slots[at]] = True
    seeds[sizes == 1] = -1 - np.flatnonzero(~taken)
    return seeds


def slots_of(first: np.ndarray, second: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    """The slot of each hashed key; a key that is not in the table gets one too."""
    seed = seeds[_buckets_of(first, len(seeds))]
    return np.where(seed < 0, -1 - seed, _mixed(second, np.maximum(seed, 0), n))


_SHARDS = "lang string, shard bigint, shards bigint, n bigint, seeds binary, keys binary, ends binary"


def hash_shards(kept: DataFrame, shard_keys: int = SHARD_KEYS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Perfect hashes of the kept terms with their keys, first slot and wave, one row per shard."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_keys).cast("bigint").alias("shards"))

    def deal(batches):
        for batch in batches:
            first, _ = key_hashes([term.encode() for term in batch.column("term").to_pylist()])
            shard = (first % batch.column("shards").to_numpy().astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(term.encode() for term in frame["term"])
        seeds = perfect_hash(keys)
        placed: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, slots_of(*key_hashes(keys), len(keys), seeds).tolist()):
            placed[slot] = key
        ends = np.cumsum([len(key) for key in placed]).astype("<i8").tobytes()
        one = {name: [frame[name].iloc[0]] for name in ("lang", "shard", "shards")}
        return pd.DataFrame(one | {"n": [len(keys)], "seeds": [seeds.astype("<i8").tobytes()], "keys": [b"".join(placed)], "ends": [ends]})

    dealt = kept.join(sizes, "lang").select("lang", "term", "shards").mapInArrow(deal, "lang string, term string, shards bigint, shard bigint")
    built = cut_lineage(dealt.groupBy("lang", "shard").applyInPandas(build, _SHARDS))
    # One row per shard: the running sums run over few rows.
    bytes_so_far = F.sum(F.length("seeds") + F.length("keys") + F.length("ends")).over(W.orderBy("lang", "shard"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut_lineage(built.withColumn("base", before).withColumn("wave", F.floor(bytes_so_far / wave_bytes).cast("bigint")))


class Hashes:
    """The perfect hashes of one wave, by language."""

    def __init__(self, rows: list):
        self.of: dict[str, dict[int, tuple]] = {}
        self.shards: dict[str, int] = {}
        for row in rows:
            ends = np.frombuffer(row["ends"], "<i8")
            self.of.setdefault(row["lang"], {})[row["shard"]] = (row["n"], np.frombuffer(row["seeds"], "<i8"), bytes(row["keys"]), ends, row["base"])
            self.shards[row["lang"]] = row["shards"]

    def range_of(self, lang: str) -> tuple[int, int]:
        """First slot of the language in this wave, and the number of slots to the last."""
        held = self.of[lang].values()
        low = min(h[4] for h in held)
        return low, max(h[4] + h[0] for h in held) - low

    def slots(self, lang: str, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(places, slots)``: which of the terms are kept, and their slots of the language."""
        first, second = key_hashes(terms)
        shard_of = (first % np.uint64(self.shards[lang])).astype(np.int64)
        places, found = [], []
        for shard, (n, seeds, keys, ends, base) in self.of[lang].items():
            mine = np.flatnonzero(shard_of == shard)
            slots = slots_of(first[mine], second[mine], n, seeds)
            begins = np.where(slots > 0, ends[slots - 1], 0).tolist()
            same = [keys[a:b] == terms[at] for at, a, b in zip(mine.tolist(), begins, ends[slots].tolist())]
            same = np.array(same, bool)
            places.append(mine[same])
            found.append(slots[same] + base)
        return np.concatenate(places), np.concatenate(found)


def group_counts(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """``(lang, source, slot, n)``: occurrences of the kept terms in each group, where there are any."""
    context, parts = texts.sparkSession.sparkContext, []
    waves = shards.agg(F.max("wave")).first()[0]
    for wave in range(0 if waves is None else waves + 1):
        rows = shards.filter(F.col("wave") == wave).select("lang", "shard", "shards", "n", "seeds", "keys", "ends", "base").collect()
        if not rows:
            continue
        parts.append(_wave_counts(texts, context.broadcast([row.asDict() for row in rows])))
    if not parts:
        return texts.sparkSession.createDataFrame([], "lang string, source string, slot bigint, n bigint")
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts.groupBy(*_GROUP, "slot").agg(F.sum("n").alias("n"))


def _wave_counts(texts: DataFrame, shared) -> DataFrame:
    def run(batches):
        hashes = Hashes(shared.value)
        held: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def passed_on():
            for (lang, source), slots in dense.items():
                at = np.flatnonzero(slots)
                if len(at):
                    names = [pa.array([name] * len(at), pa.string()) for name in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(at + hashes.range_of(lang)[0]), pa.array(slots[at])], [*_GROUP, "slot", "n"])
            dense.clear()

        def increment():
            for group, counts in held.items():
                lang, terms = group[0], list(counts)
                low, width = hashes.range_of(lang)
                if group not in dense:
                    if dense and sum(map(len, dense.values())) + width > HELD_SLOTS:
                        yield from passed_on()
                    dense[group] = np.zeros(width, np.int64)
                places, slots = hashes.slots(lang, terms)
                dense[group][slots - low] += np.fromiter(counts.values(), np.int64, len(terms))[places]
            held.clear()

        for batch in slices(batches):
            columns = (batch.column(name).to_pylist() for name in (*_GROUP, "text"))
            for lang, source, text in zip(*columns):
                if lang in hashes.of and (terms := terms_of(text)):
                    held.setdefault((lang, source), Counter()).update(terms)
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from increment()
        yield from increment()
        yield from passed_on()

    return texts.mapInArrow(run, "lang string, source string, slot bigint, n bigint")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), without rounding."""
    high = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", high.cast("decimal(38,0)"), (total + SMOOTHING * terms).cast("decimal(38,0)"))


def exact_shares(counts: np.ndarray, wholes: np.ndarray) -> np.ndarray:
    """The same for whole arrays: three digits at a time, so that nothing overflows below 9 * 10^15 terms."""
    rest, out = counts + SMOOTHING, np.zeros(np.broadcast_shapes(counts.shape, wholes.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // wholes
        rest = rest % wholes
    return out + 1


def _pair_values(counts: DataFrame, groups: DataFrame, block: int, sources: int) -> DataFrame:
    """``(lang, source, item, value)`` of every two sources of a language.

    Counts meet in blocks of some slots and some sources by some sources, so a task holds
    a matrix of fixed size. Every source is in every block of its language, counts or not.
    """
    numbered = cut_lineage(groups.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("bigint")
    every = numbered.select(*_GROUP, F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"), F.lit(-1).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("n"))
    there = counts.select(*_GROUP, F.floor(F.col("slot") / block).cast("bigint").alias("block"), F.pmod("slot", F.lit(block)).cast("bigint").alias("slot"), "n")
    per_lang = numbered.groupBy("lang").agg(F.floor(F.max("at") / sources).cast("int").alias("last"))
    own = F.floor(F.col("at") / sources).cast("int")
    rows = (
        every.unionByName(there)
        .join(numbered, _GROUP)
        .join(per_lang, "lang")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("lang", "block", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), F.col("at").cast("bigint").alias("at"), "slot", "n", "total", "terms")
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        marks = frame[frame["slot"] < 0].drop_duplicates("at").sort_values("at")
        terms = int(marks["terms"].iloc[0])
        lang, low, high, start = frame["lang"].iloc[0], frame["low"].iloc[0], frame["high"].iloc[0], int(frame["block"].iloc[0]) * block
        width = max(0, min(block, terms - start))
        at = marks["at"].to_numpy()
        table = np.zeros((len(at), width), np.int64)
        real = frame[frame["slot"] >= 0]
        table[np.searchsorted(at, real["at"].to_numpy()), real["slot"].to_numpy()] = real["n"].to_numpy()
        if width:
            table = exact_shares(table, (marks["total"].to_numpy() + SMOOTHING * terms)[:, None])
        out = []
        for i in np.flatnonzero(at // sources == low):
            values = np.abs(table - table[i]).sum(axis=1)
            for j in np.flatnonzero(at // sources == high):
                if i != j:
                    out.append((lang, at[i], at[j], values[j]))
                    if low != high:
                        out.append((lang, at[j], at[i], values[j]))
        return pd.DataFrame(out, columns=["lang", "a", "b", "value"]).astype({"a": "int64", "b": "int64", "value": "int64"})

    parts = rows.groupBy("lang", "block", "low", "high").applyInPandas(compare, "lang string, a bigint, b bigint, value bigint")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = numbered.select("lang", F.col("at").cast("bigint").alias("at"), "source")
    return (
        sums.join(names.withColumnRenamed("at", "a"), ["lang", "a"])
        .join(names.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        .select(*_GROUP, "item", "value")
    )


def _term_values(counts: DataFrame, groups: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """``(lang, source, item, value)`` of the terms that a group uses most above its language."""
    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n_lang")).join(terms, ["lang", "slot"])
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    own = _share(F.col("n"), F.col("total"), F.col("terms"))
    common = _share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    above = (
        counts.join(whole, ["lang", "slot"])
        .join(groups, _GROUP)
        .join(of_lang, "lang")
        .select(*_GROUP, F.col("term").alias("item"), (own - common).alias("value"))
        .filter("value > 0")
    )
    # Two levels: a group is cut in slices first.
    order = [F.desc("value"), F.asc("item")]
    sliced = W.partitionBy(*_GROUP, "slice").orderBy(*order)
    first = above.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(8))).withColumn("at", F.row_number().over(sliced)).filter(F.col("at") <= top)
    return first.withColumn("at", F.row_number().over(W.partitionBy(*_GROUP).orderBy(*order))).filter(F.col("at") <= top).select(*_GROUP, "item", "value")


def source_divergence(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    shard_keys: int = SHARD_KEYS,
    wave_bytes: int = WAVE_BYTES,
    slot_block: int = SLOT_BLOCK,
    source_block: int = SOURCE_BLOCK,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: how far a source's frequencies are from those of each other source of
    the language, summed over all kept terms. Part ``term``: the ``top`` terms that are
    more frequent in the source than in the language.
    """
    texts = grouped_texts(docs)
    shards = hash_shards(cut_lineage(kept_terms(texts, min_docs)), shard_keys, wave_bytes)
    counts = cut_lineage(group_counts(texts, shards))
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = counts.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    groups = cut_lineage(
        texts.select(*_GROUP).distinct().join(totals, _GROUP, "left").join(sizes, "lang", "left")
        .select(*_GROUP, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    )
    terms = cut_lineage(stored_terms(shards))
    pairs = _pair_values(counts, groups, slot_block, source_block)
    found = _term_values(counts, groups, terms, top)
    ranked = F.row_number().over(W.partitionBy(*_GROUP, "part").orderBy(F.desc("value"), F.asc("item")))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(found.withColumn("part", F.lit("term")))
    return both.select(*_GROUP, "part", "item", "value", ranked.cast("int").alias("rank"))


def stored_terms(shards: DataFrame) -> DataFrame:
    """``(lang, slot, term)``: the keys in the order of their slots."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["ends"], "<i8").tolist()
                keys = [row["keys"][a:b].decode() for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["lang"]] * row["n"], pa.string()), pa.array(np.arange(row["n"]) + row["base"]), pa.array(keys, pa.string())], ["lang", "slot", "term"]
                )

    return shards.select("lang", "n", "keys", "ends", "base").mapInArrow(run, "lang string, slot bigint, term string")
