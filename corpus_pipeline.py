"""From raw documents to packed training sequences.

Five stages, each over all that the one before it kept: documents of low quality go, one
document of each near-duplicate group stays, strings that repeat across documents are cut
out, secrets are replaced, and what is left is packed into sequences. Every stage but the
last returns the columns of its input; null texts pass through as they are. A stage's result
is written before the next stage begins, and the steps behind it are deleted then.
"""

from __future__ import annotations

import functools

from public_tokenizers import path as vocabulary_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import minhash, packing, quality, secret_scan, suffixes
from rankloom.llm.common import table, workers_find_package
from rankloom.session import cut_lineage, drop_steps, recorded_steps


# Rows of the batches that tasks hand to Python workers; a stage's rows are whole documents.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Steps of earlier stages that are still on disk.
_left: list[str] = []


def stage(function):
    """What every stage begins with.

    Its input is the written result of the stage before, so the steps that led to it are
    deleted, unless the input reads one of them. The last stage's steps stay with its result.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        if spark.conf.get(_BATCH) == "10000":  # as nobody set it
            spark.conf.set(_BATCH, BATCH_ROWS)
        _left[:] = drop_steps(spark, _left, docs)
        with recorded_steps() as steps:
            out = function(spark, docs, sf_dir)
        if function.__name__ != STAGES[-1][1].__name__:
            _left.extend(steps)
        return out

    return run_stage


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this input's labelled documents, does not reject."""
    return quality.good_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of rows that repeat an id, one."""
    judged = cut_lineage(minhash.near_duplicates(docs).select("doc_id", "kept"))
    gone = judged.filter("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    repeated = judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return left
    again = left.join(repeated, left["doc_id"] == repeated["doc_id"], "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*columns)
    first = again.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*columns)).alias("row")).select("row.*")
    return left.join(repeated, left["doc_id"] == repeated["doc_id"], "left_anti").unionByName(first)


@stage
def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start in two places."""
    return suffixes.without_repeats(docs)


@stage
def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark."""
    return secret_scan.redacted(docs, secret_scan.fit(docs))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their ids."""
    return packing.pack(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", no_repeats),
    ("secret scan", no_secrets),
    ("packing", packed),
]

# The classifier and the tokenizer cannot be written in SQL; tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
