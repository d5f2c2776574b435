"""Retrieval collections: documents, queries and relevance judgements.

A collection is three tables::

    corpus  (corpus_id string, title string, text string)
    queries (query_id string, text string)
    qrels   (query_id string, corpus_id string, relevance int, ord bigint)

``ord`` numbers the judgements of a query from 1, in file order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.ordering import number_within

CORPUS_SCHEMA = "_id string, title string, text string"
QUERIES_SCHEMA = "_id string, text string"
QRELS_SCHEMA = "`query-id` string, `corpus-id` string, score int"

NEST_SIZE = 10_000


@dataclass(frozen=True)
class Collection:
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``_id``, ``title`` and ``text``."""
    return spark.read.schema(CORPUS_SCHEMA).json(path).select(
        F.col("_id").alias("corpus_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def read_queries(spark: SparkSession, path: str, qrels: DataFrame | None = None) -> DataFrame:
    """JSON lines with ``_id`` and ``text``; given ``qrels``, only judged queries."""
    queries = spark.read.schema(QUERIES_SCHEMA).json(path).select(F.col("_id").alias("query_id"), "text")
    return queries if qrels is None else queries.join(qrels, "query_id", "left_semi")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgements under a header line.

    ``ord`` numbers a query's judgements, ``place`` orders all of them, as they stand in
    the files.
    """
    rows = (
        spark.read.schema(QRELS_SCHEMA)
        .csv(path, sep="\t", header=True)
        .select(
            F.col("query-id").alias("query_id"),
            F.col("corpus-id").alias("corpus_id"),
            F.col("score").alias("relevance"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line"),
        )
    )
    return number_within(rows, ["query_id"], ["file_path", "block_start"], ["line"], "ord").select(
        "query_id", "corpus_id", "relevance", "ord", F.struct("file_path", "block_start", "line").alias("place")
    )


def read_collection(spark: SparkSession, path: str, split: str = "test") -> Collection:
    qrels = read_qrels(spark, f"{path}/qrels/{split}.tsv")
    return Collection(read_corpus(spark, f"{path}/corpus.jsonl"), read_queries(spark, f"{path}/queries.jsonl", qrels), qrels)


def write_collection(collection: Collection, path: str, split: str = "test") -> None:
    """The layout ``read_collection`` reads; each name is a folder of part files."""
    collection.corpus.select(F.col("corpus_id").alias("_id"), "title", "text").write.mode("overwrite").json(f"{path}/corpus.jsonl")
    collection.queries.select(F.col("query_id").alias("_id"), "text").write.mode("overwrite").json(f"{path}/queries.jsonl")
    (
        collection.qrels.repartitionByRange("query_id", "ord")
        .sortWithinPartitions("query_id", "ord")
        .select(F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), F.col("relevance").alias("score"))
        .write.mode("overwrite").csv(f"{path}/qrels/{split}.tsv", sep="\t", header=True)
    )


def nest_qrels(qrels: DataFrame, size: int = NEST_SIZE) -> DataFrame:
    """Parallel arrays of document ids and grades, in file order.

    A query is one row as long as it has at most ``size`` judgements. One with more
    goes on in further rows (``part`` 1, 2, ...), so no row grows without bound.
    """
    judged = F.array_sort(F.collect_list(F.struct("ord", "corpus_id", "relevance")))
    return (
        qrels.withColumn("part", F.floor((F.col("ord") - 1) / size).cast("int"))
        .groupBy("query_id", "part")
        .agg(judged.alias("judged"))
        .select(
            "query_id",
            "part",
            F.col("judged.corpus_id").alias("corpus_id"),
            F.col("judged.relevance").alias("relevance"),
        )
    )


def dataset_counts(collection: Collection) -> DataFrame:
    """Number of documents, of queries, and of queries with judgements."""
    n = F.count(F.lit(1)).alias("n_rows")

    def named(name: str, df: DataFrame, count: Column) -> DataFrame:
        return df.agg(count).select(F.lit(name).alias("part"), F.col("n_rows"))

    return (
        named("corpus", collection.corpus, n)
        .unionByName(named("queries", collection.queries, n))
        .unionByName(named("qrels", collection.qrels, F.countDistinct("query_id").alias("n_rows")))
    )
