"""Requests to a text generator, the batch job around it, and its stored output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.fixed import generator_settings, template_system, template_text
from rankloom.functions.text import fill_prompt, whitespace_tokens

Generate = Callable[[list[dict]], list[list[str]]]

RESULT_SCHEMA = "query_id string, output array<string>, error string"

# Slack around the mean document length, and the least-length margin.
EXTRA_TOKENS = 50
MIN_MARGIN = 20


def generation_requests(queries: DataFrame, stem: str, generator: str, ave_len: DataFrame) -> DataFrame:
    """One request per query: prompt, input length, token budgets and sampling settings.

    A chat request also has its ``messages``; where the template has no system message it
    has an ``error`` instead and is not sent.
    """
    template, system = template_text(stem), template_system(stem)
    settings = generator_settings(generator)
    mean_len = ave_len.select("ave_len").scalar()
    sized = (
        queries.select("query_id", fill_prompt(F.lit(template), F.col("text")).alias("prompt"))
        .withColumn("input_len", (F.size(whitespace_tokens(F.col("prompt"))) + 1).cast("bigint"))
        .withColumn("ave_len", mean_len)
    )
    budget = {
        "completion": F.col("ave_len") + F.col("input_len") + EXTRA_TOKENS,
        "chat": F.col("ave_len") + F.col("input_len"),
        "local": F.col("ave_len") + EXTRA_TOKENS,
    }[settings["style"]]
    least = F.col("ave_len") - MIN_MARGIN if settings["style"] == "local" else F.lit(None)
    chat = settings["style"] == "chat"
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
    )
    kind = "array<struct<role:string,content:string>>"
    return sized.select(
        "query_id",
        "prompt",
        (messages if chat and system is not None else F.lit(None)).cast(kind).alias("messages"),
        F.lit("system message missing" if chat and system is None else None).cast("string").alias("error"),
        "input_len",
        F.lit(settings["style"]).alias("style"),
        budget.alias("max_tokens"),
        least.cast("bigint").alias("min_tokens"),
        F.lit(settings["do_sample"]).cast("boolean").alias("do_sample"),
        F.lit(settings["top_k"]).cast("int").alias("top_k"),
        F.lit(settings["top_p"]).cast("double").alias("top_p"),
        F.lit(settings["num_return_sequences"]).cast("int").alias("n_samples"),
        F.lit(settings["temperature"]).cast("double").alias("temperature"),
    )


def run_generation(
    requests: DataFrame, make_generate: Callable[[], Generate], partitions: int | None = None, batch: int = 64
) -> DataFrame:
    """Apply a caller's batch function; a failing request is recorded and skipped.

    ``make_generate`` runs once per task and returns the function, so a model is loaded
    once and not per batch. A request that has an ``error`` is not tried. When a batch fails, its requests are tried one by one, so one
    bad prompt costs only its own row.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generate()

        def alone(request: dict) -> tuple:
            try:
                return list(generate([request])[0]), None
            except Exception as error:  # any failure of the caller's code is a result row
                return None, f"{type(error).__name__}: {error}"

        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].to_dict("records")
                refused = [request for request in part if request.get("error")]
                if refused:
                    yield pd.DataFrame(
                        {
                            "query_id": [request["query_id"] for request in refused],
                            "output": None,
                            "error": [request["error"] for request in refused],
                        }
                    )
                    part = [request for request in part if not request.get("error")]
                try:
                    outputs = generate(part)
                    if len(outputs) != len(part):
                        raise ValueError("one list of texts per request is needed")
                    results = [(list(texts), None) for texts in outputs]
                except Exception:
                    results = [alone(request) for request in part]
                yield pd.DataFrame(
                    {
                        "query_id": [request["query_id"] for request in part],
                        "output": [output for output, _ in results],
                        "error": [error for _, error in results],
                    }
                )

    spread = requests.repartition(partitions, "query_id") if partitions else requests.repartition("query_id")
    return spread.mapInPandas(work, RESULT_SCHEMA)


def assemble_generations(results: DataFrame, queries: DataFrame, positives: DataFrame, order: str | None = None) -> DataFrame:
    """Successful outputs with query text and ground truth, one row per query.

    With ``order`` the last of several results of a query is kept.
    """
    done = results.filter(F.col("error").isNull())
    if order is not None:
        done = done.groupBy("query_id").agg(F.max_by("output", order).alias("output"))
    return (
        done.select("query_id", "output")
        .join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        .join(positives, "query_id")
        .select("query_id", "corpus_id", "query", "gt", "output")
    )


def explode_samples(generations: DataFrame) -> DataFrame:
    """One row per sample; evaluation uses the first (``sample`` 0)."""
    return generations.select("query_id", F.posexplode("output").alias("sample", "text"))
