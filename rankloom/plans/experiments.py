"""The experiments a user runs: expand, retrieve, evaluate; generate; search by generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.fixed import INPUT_CAP, MAX_LENGTH, NUM_BEAMS, RETRIEVERS
from rankloom.functions.tokens import cut_at_pad
from rankloom.operators.beam import BatchScorer, Scorer, beams_to_run, constrained_beam_search, stored_search_index
from rankloom.operators.dense import dense_search, encode_vectors
from rankloom.operators.evaluation import metric_report, zero_fill
from rankloom.operators.generation import Generate, assemble_generations, generation_requests, run_generation
from rankloom.operators.lexical import bm25_index, bm25_search
from rankloom.operators.list_metrics import list_ndcg
from rankloom.operators.prefix import sequence_documents, unmatched_sequences
from rankloom.operators.rewriting import expand_query, first_positive, hit_flags, judged_queries, limit_queries, render_prompt
from rankloom.operators.tokens import build_vocab, chunked, encode_tokens, framed, head_mean_length, truncated
from rankloom.session import cut_lineage
from rankloom.sources.collection import Collection
from rankloom.sources.store import read_embeddings


def retrieve(
    collection: Collection,
    queries: DataFrame,
    retriever: str = "bm25",
    k: int = 1000,
    score: str = "dot",
    encode: Callable[[Column], Column] | None = None,
    embedding_path: str | None = None,
) -> DataFrame:
    """Run of a named retriever; ``embedding_path`` reuses or stores document vectors."""
    kind = RETRIEVERS[retriever]
    if kind == "bm25":
        return bm25_search(bm25_index(collection.corpus), queries, k)
    if kind != "sentence_transformers":
        raise ValueError(f"{retriever} has its own experiment: constrained_experiment")
    titled = collection.corpus.select("corpus_id", F.trim(F.concat_ws(" ", "title", "text")).alias("text"))
    build = lambda: encode_vectors(titled, "corpus_id", encode=encode)
    vectors = build() if embedding_path is None else read_embeddings(queries.sparkSession, embedding_path, build)
    return dense_search(encode_vectors(queries, "query_id", encode=encode), vectors, k, score)


def retrieval_experiment(
    collection: Collection,
    generations: DataFrame | None = None,
    method: str = "none",
    retriever: str = "bm25",
    missing: str = "error",
    **options,
) -> DataFrame:
    """Expand the queries, retrieve, and report NDCG, MAP, Recall and P at every cut-off."""
    queries = collection.queries
    if method in ("syn", "syn_q", "q_syn"):
        if generations is None:
            raise ValueError(f"method {method!r} needs generations")
        queries = expand_query(queries, collection.qrels, generations, method, missing)
    return metric_report(retrieve(collection, queries, retriever, **options), collection.qrels)


def generation_job(
    collection: Collection,
    make_generate: Callable[[], Generate],
    stem: str,
    generator: str,
    corpus_order: Column,
    max_gen: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(generations, failures)`` for the judged queries of a collection."""
    queries = judged_queries(collection.queries, collection.qrels)
    if max_gen is not None:
        queries = limit_queries(queries, collection.qrels, max_gen)
    requests = generation_requests(queries, stem, generator, head_mean_length(collection.corpus, corpus_order))
    # Stored once: both outputs read the same results and the generator runs a single time.
    results = cut_lineage(run_generation(requests, make_generate))
    positives = first_positive(collection.qrels, collection.corpus)
    failures = results.filter(F.col("error").isNotNull()).select("query_id", "error")
    return assemble_generations(results, queries, positives), failures


def corpus_sequences(corpus: DataFrame, vocab: DataFrame, max_length: int = MAX_LENGTH, chunk: bool = False) -> DataFrame:
    """Framed sequences: one per document, or one per whole chunk."""
    # Chunks are cut from that many ids.
    encoded = encode_tokens(corpus, vocab, limit=INPUT_CAP if chunk else max_length)
    return framed(chunked(encoded, max_length) if chunk else truncated(encoded, max_length))


def prompt_tokens(queries: DataFrame, vocab: DataFrame, stem: str, cap: int) -> DataFrame:
    """``(query_id, tokens)`` of the rendered prompts, as many ids as fit below ``cap`` with an end id."""
    return encode_tokens(render_prompt(queries, stem), vocab, "query_id", "prompt", limit=cap - 1)


def constrained_experiment(
    collection: Collection,
    max_length: int = MAX_LENGTH,
    num_beams: int = NUM_BEAMS,
    chunk: bool = False,
    scorer: Scorer | BatchScorer | None = None,
    max_gen: int | None = None,
    stem: str = "nq",
    input_cap: int = INPUT_CAP,
) -> DataFrame:
    """Search by generating stored sequences only; same report as the other retrievers.

    Queries are rendered as prompts and capped. With ``chunk`` the sequences are the whole
    chunks of the documents; a document has the score of its best chunk, and one too short
    for a chunk is judged but never found.
    """
    vocab = build_vocab(collection.corpus)
    sequences = cut_lineage(corpus_sequences(collection.corpus, vocab, max_length, chunk))
    queries = judged_queries(collection.queries, collection.qrels)
    if max_gen is not None:
        queries = limit_queries(queries, collection.qrels, max_gen)
    beams = constrained_beam_search(
        stored_search_index(sequences),
        prompt_tokens(queries, vocab, stem, input_cap),
        num_beams,
        max_length + 1,
        scorer,
    )
    run = cut_lineage(beams_to_run(beams, sequences))
    asked = collection.qrels.join(queries.select("query_id"), "query_id", "left_semi")
    return metric_report(zero_fill(run, asked, collection.corpus), asked, include_empty=True, ranked_run=True)


# Fixed value: ids of prompt and sequence together, in the single-document run.
MODEL_IDS = 510


def first_document_experiment(
    collection: Collection,
    corpus_order: Column,
    max_length: int = MAX_LENGTH,
    num_beams: int = NUM_BEAMS,
    scorer: Scorer | BatchScorer | None = None,
    stem: str = "nq",
    ks: tuple[int, ...] = (1, 5, 10),
) -> tuple[DataFrame, DataFrame]:
    """``(report, errors)``: nDCG of the documents that generated sequences stand for.

    The search goes through complete sequences that others continue. A sequence stands for
    the first document that has it; one that is no document's is an error row and leaves no
    place in the list. A document is a hit if it is the query's first judged one. Lists
    shorter than a cut-off are filled up with misses.
    """
    vocab = build_vocab(collection.corpus)
    order = collection.corpus.select("corpus_id", corpus_order.alias("ord"))
    sequences = cut_lineage(corpus_sequences(collection.corpus, vocab, max_length).join(order, "corpus_id"))
    queries = judged_queries(collection.queries, collection.qrels)
    beams = constrained_beam_search(
        stored_search_index(sequences, "pass"),
        prompt_tokens(queries, vocab, stem, MODEL_IDS - max_length),
        num_beams,
        max_length,
        scorer,
    )
    outputs = cut_lineage(beams.select("query_id", "rank", cut_at_pad(F.col("tokens")).alias("tokens")))
    flags = hit_flags(sequence_documents(outputs, sequences, "first").select("query_id", "corpus_id", "rank"), collection.qrels, first_only=True)
    # A query brings num_beams rows at most.
    hits = F.transform(F.array_sort(F.collect_list(F.struct("rank", "corpus_id", "hit"))), lambda x: x["hit"])
    lists = flags.groupBy("query_id").agg(hits.alias("hits"))
    misses = F.array_repeat(F.lit(0), max(ks))
    rows = queries.select("query_id").join(lists, "query_id", "left").select(
        F.slice(F.concat(F.coalesce("hits", F.array().cast("array<int>")), misses), 1, max(ks)).alias("predictions"),
        F.array(F.lit(1)).alias("references"),
    )
    return list_ndcg(cut_lineage(rows), list(ks)), unmatched_sequences(outputs, sequences)
