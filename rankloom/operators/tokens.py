"""Vocabulary, encoded sequences and their length profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.fixed import INPUT_CAP, MAX_LENGTH
from rankloom.functions.text import whitespace_tokens
from rankloom.functions.tokens import END_ID, FIRST_TOKEN_ID, UNKNOWN_ID, frame_sequence, full_chunks, truncate_tokens
from rankloom.operators.ordering import number_all
from rankloom.session import BROADCAST_ROWS, fits

# The frequent head of the vocabulary that encode_tokens may broadcast: at most this many
# tokens, fewer where they are long.
_HEAD_TOKENS = 400_000
# Places of tokens are multiples of it: more than any id.
_PLACE = 1 << 32


def build_vocab(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, token_id, n, df)``: ids dense from 3, frequent tokens first, ties by token.

    0 is the start and pad id, 1 the end id, 2 stands for tokens outside the vocabulary.
    """
    tokens = whitespace_tokens(F.col(text_col))
    # Every occurrence counts for n, the distinct tokens of a text for df: one aggregation.
    both = F.array(
        F.struct(tokens.alias("tokens"), F.lit(1).alias("n"), F.lit(0).alias("df")),
        F.struct(F.array_distinct(tokens).alias("tokens"), F.lit(0).alias("n"), F.lit(1).alias("df")),
    )
    counts = (
        texts.select(F.explode(both).alias("b"))
        .select("b.n", "b.df", F.explode("b.tokens").alias("token"))
        .groupBy("token")
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    )
    return number_all(counts, [F.desc("n"), F.asc("token")], "token_id", FIRST_TOKEN_ID).select(
        "token", F.col("token_id").cast("int").alias("token_id"), "n", "df"
    )


def encode_tokens(
    texts: DataFrame, vocab: DataFrame, id_col: str = "corpus_id", text_col: str = "text", limit: int | None = None
) -> DataFrame:
    """Text to ``tokens ARRAY<INT>``, in order; a text without tokens gives an empty array.

    ``limit`` takes that many tokens of a text, for sequences that use no more; the rest is
    then neither looked up nor shuffled.

    Frequent tokens hold most of the rows and would pile up on a few join keys. Ids follow
    frequency, so the head of the vocabulary is a small table of bounded size: it is
    broadcast, and only occurrences of the rare tail are shuffled to meet their ids.
    """
    split = whitespace_tokens(F.col(text_col))
    if limit is not None:
        split = F.slice(split, 1, limit)
    placed = texts.select(F.col(id_col), F.posexplode_outer(split).alias("pos", "token"))
    ids, head = vocab.select("token", "token_id"), _HEAD_TOKENS
    while head > 1 and not fits(ids.filter(F.col("token_id") < FIRST_TOKEN_ID + head)):
        head //= 2
    is_head = F.col("token_id") < FIRST_TOKEN_ID + head
    seen = placed.join(F.broadcast(ids.filter(is_head)), "token", "left")
    tail = ids.filter(~is_head)
    if not tail.isEmpty():
        known = F.col("token_id").isNotNull() | F.col("token").isNull()
        rare = seen.filter(~known).drop("token_id").join(tail, "token", "left")
        seen = seen.filter(known).unionByName(rare)
    # Place and id in one number: half the bytes of a pair where they are shuffled.
    one = F.col("pos").cast("bigint") * _PLACE + F.coalesce("token_id", F.lit(UNKNOWN_ID))
    return (
        seen.groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), one))).alias("placed"))
        .select(id_col, F.transform("placed", lambda v: (v % _PLACE).cast("int")).alias("tokens"))
    )


def truncated(encoded: DataFrame, max_length: int = MAX_LENGTH, end_id: int | None = END_ID) -> DataFrame:
    """``truncate_tokens``: at most ``max_length`` ids, the end id kept last."""
    return encoded.withColumn("tokens", truncate_tokens(F.col("tokens"), max_length, end_id))


def chunked(encoded: DataFrame, max_length: int = MAX_LENGTH, cap: int = INPUT_CAP, id_col: str = "corpus_id") -> DataFrame:
    """Whole chunks of the first ``cap`` ids (end id included); ``chunk`` counts from 0."""
    chunks = full_chunks(F.col("capped"), max_length)
    return encoded.select(id_col, truncate_tokens(F.col("tokens"), cap).alias("capped")).select(
        id_col, F.posexplode(chunks).alias("chunk", "tokens")
    )


def unchunkable_docs(encoded: DataFrame, max_length: int = MAX_LENGTH, id_col: str = "corpus_id") -> DataFrame:
    """Documents too short for a single chunk: chunking makes them unreachable."""
    return encoded.select(id_col, (F.size("tokens") + 1).alias("n_tokens")).filter(F.col("n_tokens") < max_length)


def framed(sequences: DataFrame) -> DataFrame:
    """``frame_sequences``: the start id in front of every sequence."""
    return sequences.withColumn("tokens", frame_sequence(F.col("tokens")))


def capped_length(text: Column, cap: int = INPUT_CAP) -> Column:
    """Number of ids of a text, end id included, at most ``cap``."""
    return F.least(F.size(whitespace_tokens(text)) + 1, F.lit(cap))


def token_length_stats(lengths: DataFrame) -> DataFrame:
    """Mean, median and population deviation of ``length`` for each ``part``.

    Lengths are capped, so the exact median keeps at most ``cap`` counters per part.
    """
    return lengths.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("length").alias("mean"),
        F.median("length").cast("double").alias("median"),
        F.stddev_pop("length").alias("std"),
    )


def token_length_histogram(lengths: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins from the least to the greatest length; the last one is closed.

    When all lengths are equal the range is half a unit to either side.
    """
    counted = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    span = counted.agg(F.min("length").cast("double").alias("lo"), F.max("length").cast("double").alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    span = span.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()

    def edge(i: Column) -> Column:
        return F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins

    at = F.least(F.floor((F.col("length") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    filled = counted.withColumn("lo", lo).withColumn("hi", hi).groupBy(at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    frame = span.filter(F.col("lo").isNotNull()).select(
        "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return frame.join(filled, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("left_edge"),
        edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def head_mean_length(corpus: DataFrame, order: Column, n: int = 100) -> DataFrame:
    """Mean token count of the first ``n`` documents, rounded down: ``(ave_len)``."""
    head = corpus.select(order.alias("_order"), "text").orderBy("_order").limit(n)
    length = F.size(whitespace_tokens(F.col("text"))) + 1
    return head.agg(F.floor(F.avg(length)).alias("ave_len"))


assert _HEAD_TOKENS <= BROADCAST_ROWS
