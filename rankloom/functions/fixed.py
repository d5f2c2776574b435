"""Fixed values that must equal the public experiment settings for equal results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut-offs of the ranked metrics.
K_VALUES = (1, 3, 5, 10, 100, 1000)

# Sequence and prompt limits.
MAX_LENGTH = 128
INPUT_CAP = 2048
NUM_BEAMS = 10
MAX_GEN = 1_000_000_000_000

# The system message of the chat templates.
SYSTEM_MESSAGE = "You are a helpful assistant that generates useful document that help the user request."

# Fixed values: (stem, template_name, system, template).
TEMPLATES = [
    ("arguana", "arguana", None, "Please write a counter argument for the Passage\nPassage: [QUERY]\nCounter Argument: "),
    ("arguana_hyde", "arguana_hyde", None, "Please write a counter argument for the passage\nPassage: [QUERY]\nCounter Argument:"),
    ("dbpedia-entity", "dbpedia", None, "Please write a Wikipedia passage to answer the Question.\nQuestion: [QUERY]\nPassage: "),
    ("dbpedia-entity_def", "dbpedia_def", None, "Definition: write a Wikipedia passage to answer the following Question. Question: [QUERY] Output: "),
    ("dbpedia-entity_hyde", "dbpedia_hyde", SYSTEM_MESSAGE, "Please write a passage to answer the question.\nQuestion: [QUERY]\nPassage:"),
    ("fever", "fever", None, "Please write a Wikipedia passage to verify this Claim.\nClaim: [QUERY]\nPassage: "),
    ("fever_def", "fever_def", None, "Definition: write a Wikipedia passage to verify the following Claim. Claim: [QUERY] Output: "),
    ("fiqa_hyde", "fiqa_hyde", None, "Please write a financial article passage to answer the question\nQuestion: [QUERY]\nPassage:"),
    ("nq", "nq", None, "Please write a Wikipedia passage to answer the Question.\nQuestion: [QUERY]\nPassage: "),
    ("nq_def", "nq_def", None, "Definition: write a Wikipedia passage to answer the following Question. Question: [QUERY] Output: "),
    ("nq_hyde", "nq_hyde", None, "Please write a passage to answer the question.\nQuestion: [QUERY]\nPassage:"),
    ("quora", "quora", None, "Please write a Quora question that has same meaning with this Question.\nQuestion: [QUERY]\nOutput: "),
    ("quora_def", "quora_def", None, "Definition: write a Quora question that has same meaning with the following Question. Question: [QUERY] Output: "),
    ("scifact", "scifact", None, "Please write a scientific paper passage to support/refute the Claim.\nClaim: [QUERY]\nPassage: "),
    ("scifact_def", "scifact_def", None, "Definition: write a scientific paper passage to support/refute the following Claim. Claim: [QUERY] Output: "),
    ("scifact_hyde", "scifact_hyde", SYSTEM_MESSAGE, "Please write a scientific paper passage to support/refute the claim\nClaim: [QUERY]\nPassage:"),
    ("trec-covid", "trec-covid", None, "Please write a scientific paper passage to answer the Question.\nQuestion: [QUERY]\nPassage: "),
    ("trec-covid_def", "trec-covid_def", None, "Definition: write a scientific paper passage to answer the following Question. Question: [QUERY] Output: "),
    ("trec-covid_hyde", "trec-covid_hyde", SYSTEM_MESSAGE, "Please write a scientific paper passage to answer the question.\nQuestion: [QUERY]\nPassage:"),
    ("trec-news_hyde", "trec-news_hyde", None, "Please write a news passage about the topic. Topic: [QUERY]\nPassage:"),
]

# Fixed values: (name, model, style, do_sample, top_k, top_p, num_return_sequences, temperature).
GENERATORS = [
    ("chatGPT", "gpt-3.5-turbo-0301", "chat", None, None, None, 1, 0.7),
    ("flan-ul2", "google/flan-ul2", "local", True, 30, 0.95, 3, None),
    ("flan11b", "google/flan-t5-xxl", "local", True, 30, 0.95, 3, None),
    ("flan3b", "google/flan-t5-xl", "local", True, 30, 0.95, 3, None),
    ("flan3b_beam", "google/flan-t5-xl", "local", False, 30, 0.95, 1, None),
    ("flan_large", "google/flan-t5-large", "local", True, 30, 0.95, 3, None),
    ("gpt2-xl", "gpt2-xl", "local", True, 30, 0.95, 3, None),
    ("instructGPT", "text-davinci-003", "completion", None, None, None, 1, 0.7),
    ("tk11b_dp", "allenai/tk-instruct-11b-def-pos", "local", True, 30, 0.95, 3, None),
    ("tk3b_dp", "allenai/tk-instruct-3b-def-pos", "local", True, 30, 0.95, 3, None),
]
GENERATOR_SCHEMA = (
    "generator string, model string, style string, do_sample boolean, top_k int, top_p double, "
    "num_return_sequences int, temperature double"
)

# The dense encoders and the lexical and constrained retrievers, by name.
RETRIEVERS = {
    "bm25": "bm25",
    "const_gen": "const_gen",
    "contriever": "sentence_transformers",
    "contriever-msmarco": "sentence_transformers",
    "mini_l12": "sentence_transformers",
}


def template_text(stem: str) -> str:
    return {row[0]: row[3] for row in TEMPLATES}[stem]


def template_system(stem: str) -> str | None:
    return {row[0]: row[2] for row in TEMPLATES}[stem]


def generator_settings(name: str) -> dict:
    """The row of one generator by column name."""
    names = [column.split()[0] for column in GENERATOR_SCHEMA.split(", ")]
    return {row[0]: dict(zip(names, row)) for row in GENERATORS}[name]


def template_array() -> Column:
    """All templates as one constant array of structs."""
    return F.array(
        *[
            F.struct(
                F.lit(stem).alias("stem"),
                F.lit(name).alias("template_name"),
                F.lit(system).cast("string").alias("system"),
                F.lit(template).alias("template"),
            )
            for stem, name, system, template in TEMPLATES
        ]
    )
