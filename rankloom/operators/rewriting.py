"""Prompts, query expansion and the joins between queries and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.fixed import MAX_GEN, template_array, template_text
from rankloom.functions.text import fill_prompt
from rankloom.operators.ordering import number_all


def render_prompt(queries: DataFrame, stem: str = "nq") -> DataFrame:
    """One prompt per query from one template."""
    return queries.withColumn("prompt", fill_prompt(F.lit(template_text(stem)), F.col("text")))


def render_prompt_grid(queries: DataFrame) -> DataFrame:
    """A prompt for every query and template."""
    return queries.select("query_id", "text", F.explode(template_array()).alias("t")).select(
        "query_id", "t.stem", "t.template_name", fill_prompt(F.col("t.template"), F.col("text")).alias("prompt")
    )


def chat_messages(queries: DataFrame) -> DataFrame:
    """System and user message per query and template.

    A template without a system message gives an error row and no messages.
    """
    grid = queries.select("query_id", "text", F.explode(template_array()).alias("t"))
    has_system = F.col("t.system").isNotNull()
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("t.system").alias("content")),
        F.struct(F.lit("user").alias("role"), fill_prompt(F.col("t.template"), F.col("text")).alias("content")),
    )
    return grid.select(
        "query_id",
        "t.stem",
        F.when(has_system, messages).alias("messages"),
        F.when(~has_system, F.lit("system message missing")).alias("error"),
    )


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one judgement."""
    return queries.join(qrels, "query_id", "left_semi")


def expand_query(
    queries: DataFrame, qrels: DataFrame, generations: DataFrame, method: str, missing: str = "error"
) -> DataFrame:
    """Rewrite queries with their first synthetic text; nothing goes between the parts.

    ``syn``, ``syn_q`` and ``q_syn`` keep judged queries only; any other method returns
    all queries as they are. ``missing`` says what a judged query without synthetic text
    does: ``error`` fails the job, ``drop`` leaves it out.
    """
    if missing not in ("error", "drop"):
        raise ValueError(f"missing must be 'error' or 'drop', not {missing!r}")
    synthetic = F.element_at("output", 1)
    rewrites = {
        "syn": synthetic,
        "syn_q": F.concat(synthetic, F.col("text")),
        "q_syn": F.concat(F.col("text"), synthetic),
    }
    if method not in rewrites:
        return queries
    how = "left" if missing == "error" else "inner"
    first = generations.select("query_id", "output")
    found = F.when(F.col("output").isNull(), F.raise_error(F.concat(F.lit("no synthetic text for query "), F.col("query_id"))))
    text = rewrites[method]
    if missing == "error":
        text = F.coalesce(found.cast("string"), text)
    return judged_queries(queries, qrels).join(first, "query_id", how).select("query_id", text.alias("text"))


def limit_queries(queries: DataFrame, qrels: DataFrame, max_gen: int = MAX_GEN) -> DataFrame:
    """The first ``max_gen + 1`` judged queries: the check comes after the count.

    Their order is that of their first judgements (``place``).
    """
    first = qrels.groupBy("query_id").agg(F.min("place").alias("_place"))
    chosen = number_all(first, [F.col("_place")], "_n").filter(F.col("_n") <= max_gen).select("query_id")
    return queries.join(chosen, "query_id", "left_semi")


def first_positive(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ground truth of a query: its first judged document, whatever the grade."""
    first = qrels.groupBy("query_id").agg(F.min_by("corpus_id", "ord").alias("corpus_id"))
    return first.join(corpus.select("corpus_id", F.col("text").alias("gt")), "corpus_id").select(
        "query_id", "corpus_id", "gt"
    )


def hit_flags(run: DataFrame, qrels: DataFrame, first_only: bool = False) -> DataFrame:
    """1 where the retrieved document is judged for the query, at any grade; else 0.

    ``first_only`` counts only the first judged document of each query.
    """
    if first_only:
        judged = qrels.groupBy("query_id").agg(F.min_by("corpus_id", "ord").alias("corpus_id"))
    else:
        judged = qrels.select("query_id", "corpus_id").distinct()
    return run.join(judged.withColumn("hit", F.lit(1)), ["query_id", "corpus_id"], "left").withColumn(
        "hit", F.coalesce("hit", F.lit(0))
    )
