"""Views of the given Parquet tables as retrieval collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import spaced
from rankloom.operators.ordering import number_within
from rankloom.session import cut_lineage, spread
from rankloom.sources.collection import Collection

_ID_BLOCK = 1_000_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents").select("doc_id", "text"))


def documents_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``documents`` as a corpus: the first line is the title, the whole text the text."""
    return documents(spark, root).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("corpus_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text"),
    )


def passage_queries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark").select(F.concat(F.lit("q"), F.col("item_id")).alias("query_id"), "text")


def containing_documents(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` where the document contains the passage as a run of whole words.

    Each passage is joined to documents on its rarest word only, and the few candidates
    are then compared in full. A passage is contained only where each of its words is, so
    no match is lost and no pair is formed without a shared word.
    """
    docs = documents.select("doc_id", spaced(F.col("text")).alias("doc_text"))
    items = passages.select("item_id", spaced(F.col("text")).alias("item_text")).filter(F.trim("item_text") != "")
    words = items.select("item_id", F.explode(F.array_distinct(F.split(F.trim("item_text"), " "))).alias("word"))
    doc_words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.trim("doc_text"), " "))).alias("word")).join(
        words.select("word").distinct(), "word", "left_semi"
    )
    frequency = doc_words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    anchors = (
        words.join(frequency, "word", "left")
        .groupBy("item_id")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("rarest"))
        .select("item_id", F.col("rarest.word").alias("word"))
    )
    return (
        doc_words.join(anchors, "word")
        .join(items, "item_id")
        .join(docs, "doc_id")
        .filter(F.contains("doc_text", "item_text"))
        .select("doc_id", "item_id")
    )


def passage_qrels(spark: SparkSession, root: str, graded: bool = False) -> DataFrame:
    """A document containing the passage is relevant: grade 1, or 1 + quality where labelled."""
    # Judgements are an input that jobs read more than once, so they are derived once.
    pairs = cut_lineage(containing_documents(documents(spark, root), table(spark, root, "benchmark")))
    if graded:
        quality = table(spark, root, "labels").select("doc_id", "quality")
        pairs = pairs.join(quality, "doc_id", "left").withColumn("relevance", 1 + F.coalesce("quality", F.lit(0)))
    else:
        pairs = pairs.withColumn("relevance", F.lit(1))
    pairs = pairs.withColumn("block", F.floor(F.col("doc_id") / _ID_BLOCK))
    return number_within(pairs, ["item_id"], ["block"], ["doc_id"], "ord").select(
        F.concat(F.lit("q"), F.col("item_id")).alias("query_id"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("corpus_id"),
        F.col("relevance").cast("int").alias("relevance"),
        "ord",
        F.struct("item_id", "doc_id").alias("place"),
    )


def passage_collection(spark: SparkSession, root: str, graded: bool = False) -> Collection:
    """Which documents contain each benchmark passage?"""
    return Collection(documents_corpus(spark, root), passage_queries(spark, root), passage_qrels(spark, root, graded))


def _turn_id(prefix: str):
    return F.concat(F.lit(prefix), F.col("conv_id"), F.lit("-"), F.col("turn"))


def reply_collection(spark: SparkSession, root: str) -> Collection:
    """User turns as queries, assistant turns as documents, the direct reply as relevant."""
    turns = table(spark, root, "conversations")
    users = turns.filter(F.col("role") == "user")
    replies = turns.filter(F.col("role") == "assistant")
    following = replies.select("conv_id", (F.col("turn") - 1).alias("turn"), _turn_id("a").alias("corpus_id"))
    qrels = users.join(following, ["conv_id", "turn"]).select(
        _turn_id("u").alias("query_id"),
        "corpus_id",
        F.lit(1).alias("relevance"),
        F.lit(1).cast("bigint").alias("ord"),
        F.struct("conv_id", "turn").alias("place"),
    )
    return Collection(
        replies.select(_turn_id("a").alias("corpus_id"), F.lit("").alias("title"), "text"),
        users.select(_turn_id("u").alias("query_id"), "text"),
        qrels,
    )


def reply_generations(spark: SparkSession, root: str) -> DataFrame:
    """The recorded reply of a user turn stands in for its synthetic document."""
    replies = reply_collection(spark, root)
    return (
        replies.qrels.join(replies.queries, "query_id")
        .join(replies.corpus.select("corpus_id", F.col("text").alias("gt")), "corpus_id")
        .select("query_id", "corpus_id", F.col("text").alias("query"), "gt", F.array("gt").alias("output"))
    )


def vector_collection(spark: SparkSession, root: str) -> DataFrame:
    """``embeddings`` as ``(id, embedding, label)``; the same ids serve both sides."""
    return table(spark, root, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("id"), "embedding", "label"
    )
