"""BM25 over one or several text fields."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.fixed import K_VALUES
from rankloom.functions.text import word_tokens
from rankloom.operators.best import RUN_ARROW, RUN_SCHEMA, SCORE_DIGITS, best_rows, id_array
from rankloom.operators.ordering import top_k
from rankloom.session import cut_lineage, drop_step, fits

# Term saturation, length weight, and the share of the weaker fields.
K1 = 1.2
B = 0.75
TIE_BREAKER = 0.5
FIELDS = ("title", "text")

# Occurrences that one task takes apart, counts and scores. What it holds grows with them times the queries.
TASK_TOKENS = 500_000
# Partitions up to which Spark's shuffle writer streams rows to files; with more it holds a map task's rows.
_STREAMED = 200
# Terms of all queries, up to which postings are joined with them; beyond, products of blocks.
_JOINED_TERMS = 100_000
# Terms of the queries and of the documents that a task of the grid holds: 32 and 128 MB.
_QUERY_CELLS = 2_000_000
_DOC_CELLS = 8_000_000
# Queries and documents of one product, and the share of its documents from which a term is multiplied as a dense row.
_QUERY_TILE = 512
_DOC_TILE = 8_192
_DENSE_SHARE = 1 / 64


@dataclass(frozen=True)
class LexicalIndex:
    """``postings (corpus_id, field, term, dl, tf)`` and ``stats (field, n_docs, avg_len)``.

    ``texts`` holds the documents before they are taken apart by ``analyze``; a stored index
    has none, but its postings lie in ``buckets`` folders by term (column ``bucket``).
    """

    postings: DataFrame
    stats: DataFrame
    fields: tuple[str, ...]
    texts: DataFrame | None = None
    buckets: int | None = None
    analyze: Callable[[Column], Column] = word_tokens


_POSTING = ["corpus_id", "field", "term", "dl"]
POSTING_SCHEMA = "corpus_id string, field string, term string, dl int, tf long, bucket int"


def bm25_index(corpus: DataFrame, fields: tuple[str, ...] = FIELDS, analyze: Callable[[Column], Column] = word_tokens) -> LexicalIndex:
    """Term counts and field statistics. Empty fields do not count as documents."""
    # Asked for here, the ids' check is in every branch that reads the index, so they stay alike.
    texts = corpus.filter(F.col("corpus_id").isNotNull()).select("corpus_id", *fields)
    stats = (
        _lines(texts, fields, analyze)
        .filter(F.col("dl") > 0)
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len"))
    )
    return LexicalIndex(_count(_occurrences(texts, fields, analyze)), stats, tuple(fields), texts, analyze=analyze)


def bounded_tasks(stats: DataFrame) -> int:
    """As many tasks as there are texts: their size does not grow with the corpus."""
    n_tokens = stats.agg(F.sum(F.col("n_docs") * F.col("avg_len"))).first()[0] or 0
    return max(stats.sparkSession.sparkContext.defaultParallelism, math.ceil(n_tokens / TASK_TOKENS))


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt to ``tasks`` by document.

    A map task that writes to more partitions than Spark streams to files holds its rows, and a
    split may be one row group of any size. So rows are first streamed to few partitions:
    what the writers to many then hold is one of those.
    """
    if tasks > _STREAMED:
        # The dropped column keeps Spark from merging both exchanges into one.
        group = F.pmod(F.xxhash64("corpus_id"), F.lit(_STREAMED))
        rows = rows.withColumn("_group", group).repartition(_STREAMED, "_group").drop("_group")
    return rows.repartition(tasks, "corpus_id")


def counted_where_dealt(index: LexicalIndex, tasks: int, terms: DataFrame | None = None) -> DataFrame:
    """Postings counted in the tasks that whole texts are dealt to; with ``terms`` only theirs."""
    rows = _occurrences(dealt(index.texts, tasks), index.fields, index.analyze)
    return _count(rows if terms is None else rows.join(terms, "term", "left_semi"))


def _lines(texts: DataFrame, fields: tuple[str, ...], analyze: Callable[[Column], Column]) -> DataFrame:
    """``(corpus_id, field, terms, dl)``"""
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), analyze(F.col(f)).alias("terms")) for f in fields])
    return texts.select("corpus_id", F.explode(per_field).alias("f")).select("corpus_id", "f.field", "f.terms", F.size("f.terms").alias("dl"))


def _occurrences(texts: DataFrame, fields: tuple[str, ...], analyze: Callable[[Column], Column]) -> DataFrame:
    return _lines(texts, fields, analyze).select("corpus_id", "field", "dl", F.explode("terms").alias("term"))


def _count(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy(*_POSTING).agg(F.count(F.lit(1)).alias("tf"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write_bm25_index(index: LexicalIndex, path: str, buckets: int = 64) -> None:
    """Parquet, postings in folders by term bucket and sorted by term inside a file.

    Rebalancing splits the bucket of a frequent term over as many tasks as it needs.
    """
    (
        index.postings.withColumn("bucket", _bucket(buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    )
    index.stats.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/stats")


def read_bm25_index(spark, path: str, fields: tuple[str, ...] = FIELDS) -> LexicalIndex:
    """The index as stored; a search reads only the folders of its terms' buckets."""
    postings = spark.read.schema(POSTING_SCHEMA).parquet(f"{path}/postings")
    stats = spark.read.parquet(f"{path}/stats")
    first = stats.select("buckets").first()
    return LexicalIndex(postings, stats.drop("buckets"), tuple(fields), None, first["buckets"] if first else None)


class Cells:
    """Rows of lists of ``(cell, value)``, a cell being a term of a field, sorted by row."""

    def __init__(self, rows: np.ndarray, cells: np.ndarray, values: np.ndarray):
        self.rows, self.cells, self.values = rows, cells, values

    @classmethod
    def of(cls, table: pa.Table, order: np.ndarray | None = None) -> Cells:
        lists = table["cells"].combine_chunks()
        sizes, cells = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        values, rows = table["parts"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        if order is None:
            return cls(rows, cells, values)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_row = np.argsort(place[rows], kind="stable")
        return cls(place[rows][by_row], cells[by_row], values[by_row])

    def cut(self, rows: slice) -> Cells:
        a, b = np.searchsorted(self.rows, [rows.start, rows.stop])
        return Cells(self.rows[a:b] - rows.start, self.cells[a:b], self.values[a:b])

    def only(self, mask: np.ndarray) -> Cells:
        return Cells(self.rows[mask], self.cells[mask], self.values[mask])


def product_of_cells(asked: Cells, n_asked: int, given: Cells, n_given: int) -> np.ndarray:
    """Sums of products over shared cells: frequent cells as a product of matrices, rare ones pair by pair."""
    known, given_at, held = np.unique(given.cells, return_inverse=True, return_counts=True)
    if not len(known):
        return np.zeros((n_asked, n_given))
    at = np.minimum(np.searchsorted(known, asked.cells), len(known) - 1)
    asked, at = asked.only(known[at] == asked.cells), at[known[at] == asked.cells]
    dense = np.zeros(len(known), bool)
    dense[at] = held[at] >= _DENSE_SHARE * n_given
    column = np.cumsum(dense) - 1
    left, right = np.zeros((n_asked, int(dense.sum()))), np.zeros((int(dense.sum()), n_given))
    # A cell may come more than once in a row.
    np.add.at(left, (asked.rows[dense[at]], column[at[dense[at]]]), asked.values[dense[at]])
    np.add.at(right, (column[given_at[dense[given_at]]], given.rows[dense[given_at]]), given.values[dense[given_at]])
    scores = left @ right
    asked, at = asked.only(~dense[at]), at[~dense[at]]
    by_cell = np.argsort(given_at, kind="stable")
    begins = np.cumsum(held) - held
    n = held[at]
    pairs = by_cell[np.repeat(begins[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    flat = np.repeat(asked.rows, n) * n_given + given.rows[pairs]
    return scores + np.bincount(flat, np.repeat(asked.values, n) * given.values[pairs], n_asked * n_given).reshape(scores.shape)


def _by_grid(fields: tuple[str, ...], postings: DataFrame, weights: DataFrame, saturated: Column, k: int, tie_breaker: float) -> DataFrame:
    """``(query_id, corpus_id, score)``: the best of each query among each group of documents.

    Queries and documents are lists of cells and parts of scores. A task holds a bounded group of
    both and keeps the best documents of its queries while it goes through their products.
    """
    weights = cut_lineage(weights.filter(F.col("field").isin(*fields)))
    field = F.array_position(F.array(*map(F.lit, fields)), F.col("field")).cast("bigint") - 1
    cell = F.monotonically_increasing_id() * len(fields) + field
    cells = cut_lineage(weights.select("field", "term", "avg_len").distinct().select("field", "term", "avg_len", cell.alias("cell")))
    known = F.broadcast(cells) if fits(cells) else cells

    def lists(rows: DataFrame, name: str, part: Column) -> DataFrame:
        listed = rows.select(name, "cell", part.alias("part")).groupBy(name)
        return cut_lineage(listed.agg(F.collect_list("cell").alias("cells"), F.collect_list("part").alias("parts")))

    docs = lists(postings.join(known, ["field", "term"]), "corpus_id", saturated)
    queries = lists(weights.drop("avg_len").join(known, ["field", "term"]), "query_id", F.col("weight"))
    drop_step(weights)
    drop_step(cells)
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()
    (n_queries, query_cells), (_, doc_cells) = size(queries), size(docs)
    even = min(2 * docs.sparkSession.sparkContext.defaultParallelism, n_queries // 64)
    n_query_groups, n_doc_groups = max(1, even, -(-query_cells // _QUERY_CELLS), -(-n_queries * k // _DOC_CELLS)), max(1, -(-doc_cells // _DOC_CELLS))
    group_of = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = queries.withColumn("qg", group_of("query_id", n_query_groups)).select("*", every(n_doc_groups).alias("dg"))
    right = docs.withColumn("dg", group_of("corpus_id", n_doc_groups)).select("*", every(n_query_groups).alias("qg"))
    n_fields = len(fields)

    def work(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not asked.num_rows or not given.num_rows:
            return RUN_ARROW.empty_table()
        ids = id_array(given["corpus_id"])
        order = np.argsort(ids, kind="stable")[::-1]
        of_queries, of_docs = Cells.of(asked), Cells.of(given, order)

        def product(q: slice, d: slice) -> np.ndarray:
            a, b = of_queries.cut(q), of_docs.cut(d)
            each = [
                product_of_cells(a.only(a.cells % n_fields == f), q.stop - q.start, b.only(b.cells % n_fields == f), d.stop - d.start)
                for f in range(n_fields)
            ]
            best = np.maximum.reduce(each)
            return best + tie_breaker * (sum(each) - best)

        found = best_rows(id_array(asked["query_id"]), ids[order], product, k, _QUERY_TILE, _DOC_TILE, positive=True)
        return pa.Table.from_batches(found, schema=RUN_ARROW)

    return left.groupBy("qg", "dg").cogroup(right.groupBy("qg", "dg")).applyInArrow(work, RUN_SCHEMA)


def bm25_search(
    index: LexicalIndex,
    queries: DataFrame,
    k: int = max(K_VALUES),
    tie_breaker: float = TIE_BREAKER,
    k1: float = K1,
    b: float = B,
    analyze: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """``(query_id, corpus_id, score, rank)``: the ``k`` best documents of each query.

    A document scores its best field plus ``tie_breaker`` times its other fields. A
    document with the query's own id is left out.

    The terms of the queries are the side that is sent around, once they were measured to
    be few. Texts are dealt out whole, as a task that writes to more partitions than Spark
    writes directly holds all its rows; postings are cut to those terms and grouped by
    document where they are taken apart, so counting and scoring share one exchange and no
    frequent term lands in one task. With many query terms the scores are products of blocks of queries and
    documents: joined, each pair would be a row for every term that it shares.
    """
    wanted = (
        queries.select("query_id", F.explode(analyze(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    wanted = cut_lineage(wanted.filter(F.col("query_id").isNotNull()))
    few = fits(wanted)
    terms = wanted.select("term").distinct()
    terms = F.broadcast(terms) if few else terms
    stats = cut_lineage(index.stats)
    tasks = bounded_tasks(stats)
    if index.texts is not None and few:
        postings = counted_where_dealt(index, tasks, terms)
    elif index.texts is not None:
        matching = _occurrences(index.texts, index.fields, index.analyze).join(terms, "term", "left_semi")
        postings = _count(dealt(matching, tasks))
    else:
        keys = ["term"]
        if index.buckets is not None:
            terms, keys = terms.withColumn("bucket", _bucket(index.buckets)), ["bucket", "term"]
        postings = dealt(index.postings.join(terms, keys, "left_semi").drop("bucket"), tasks)
    frequency = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # stats has one row per field.
    weights = (
        frequency.join(F.broadcast(stats), "field")
        .join(F.broadcast(wanted) if few else wanted, "term")
        .select("query_id", "field", "term", (F.col("qtf") * idf).alias("weight"), "avg_len")
    )
    saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_len")))
    if not few or wanted.count() > _JOINED_TERMS:
        run = _by_grid(index.fields, postings, weights, saturated, k, tie_breaker)
        # A query has one list of the best for each group of documents: few, and cut to ``k``.
        return top_k(run, "query_id", [F.desc("score"), F.desc("corpus_id")], k, sliced=False)
    part = F.col("weight") * saturated
    per_field = [F.coalesce(F.sum(F.when(F.col("field") == f, part)), F.lit(0.0)) for f in index.fields]
    # Weights are at most the query terms times the fields, so the same measure bounds them.
    matches = postings.join(F.broadcast(weights) if few else weights, ["field", "term"])
    scored = matches.groupBy("query_id", "corpus_id").agg(F.array(*per_field).alias("scores"))
    best = F.array_max("scores")
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x)
    run = scored.filter(F.col("query_id") != F.col("corpus_id")).select(
        "query_id", "corpus_id", F.round(best + tie_breaker * (total - best), SCORE_DIGITS).alias("score")
    )
    return top_k(run, "query_id", [F.desc("score"), F.desc("corpus_id")], k)
