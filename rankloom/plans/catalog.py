"""One query per operator over the given Parquet tables.

Each query takes ``(spark, root)`` and returns a DataFrame of plain columns. Arrays are
joined into text, and real numbers are rounded, so that results compare across engines.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.fixed import MAX_LENGTH, NUM_BEAMS, template_text
from rankloom.functions.text import fill_prompt
from rankloom.functions.tokens import START_ID, TERMINAL, cut_at_pad, truncate_tokens
from rankloom.operators import beam, dense, evaluation, generation, lexical, lexical_blocks, list_metrics, prefix, rewriting, tokens
from rankloom.plans import experiments
from rankloom.session import cut_lineage, scratch_path
from rankloom.sources import collection as files
from rankloom.sources import store
from rankloom.sources import tables

DIGITS = 6
TOP = 10
# Depth of the registered searches, below the size of the smallest table.
DEPTH = 100
LIST_KS = [1, 5, 10]
# Fixed input of the weighted recall: position weights 1, 1/2, 1/3, ...
POSITION_WEIGHTS = [1.0 / (i + 1) for i in range(TOP)]
# Judgements per row of nest_qrels, few enough that queries take several rows.
NEST_ROWS = 2
VECTOR_DIM = 256

Query = DataFrame


def _rounded(value: str | Column, digits: int = DIGITS) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def _joined(array: str | Column) -> Column:
    return F.array_join(array, " ")


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# --- shared inputs -----------------------------------------------------------------


def _docs_with_ids(spark: SparkSession, root: str) -> DataFrame:
    return tables.table(spark, root, "documents").select("doc_id", "text")


def _encoded(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    corpus = tables.documents_corpus(spark, root)
    vocab = tokens.build_vocab(corpus)
    return tokens.encode_tokens(corpus, vocab), vocab


def _encoded_heads(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """As many ids of each document as a sequence takes."""
    corpus = tables.documents_corpus(spark, root)
    vocab = tokens.build_vocab(corpus)
    return tokens.encode_tokens(corpus, vocab, limit=MAX_LENGTH), vocab


def _sequences(spark: SparkSession, root: str) -> DataFrame:
    return tokens.framed(tokens.truncated(_encoded_heads(spark, root)[0]))


def _stored_sequences(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Sequences for a job that reads them more than once, and the vocabulary."""
    encoded, vocab = _encoded_heads(spark, root)
    return cut_lineage(tokens.framed(tokens.truncated(encoded))), vocab


def _plain_sequences(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Titles and texts without end ids, and the vocabulary: a title is the beginning of its text."""
    corpus = tables.documents_corpus(spark, root)
    titles = corpus.select(F.concat(F.lit("t"), "corpus_id").alias("corpus_id"), F.col("title").alias("text"))
    vocab = tokens.build_vocab(corpus)
    plain = tokens.truncated(tokens.encode_tokens(corpus.select("corpus_id", "text").unionByName(titles), vocab, limit=MAX_LENGTH), MAX_LENGTH, None)
    return cut_lineage(tokens.framed(plain)), vocab


def _reply_sequences(spark: SparkSession, root: str, vocab: DataFrame) -> DataFrame:
    replies = tables.reply_collection(spark, root).corpus
    return tokens.framed(tokens.truncated(tokens.encode_tokens(replies, vocab, limit=MAX_LENGTH)))


def _bm25_run(spark: SparkSession, root: str, k: int = 1000) -> DataFrame:
    index = lexical.bm25_index(tables.documents_corpus(spark, root))
    return lexical.bm25_search(index, tables.passage_queries(spark, root), k)


def _stored_passages(spark: SparkSession, root: str) -> str:
    path = scratch_path(spark, "collection")
    files.write_collection(tables.passage_collection(spark, root), path)
    return path


def _lengths(spark: SparkSession, root: str) -> DataFrame:
    queries = tables.passage_queries(spark, root)
    prompts = fill_prompt(F.lit(template_text("nq")), F.col("text"))

    def part(name: str, df: DataFrame, text: Column) -> DataFrame:
        return df.select(F.lit(name).alias("part"), tokens.capped_length(text).alias("length"))

    return (
        part("queries", queries, F.col("text"))
        .unionByName(part("prompts", queries, prompts))
        .unionByName(part("documents", tables.documents_corpus(spark, root), F.col("text")))
    )


# --- sources and sinks -------------------------------------------------------------


def read_corpus(spark: SparkSession, root: str) -> Query:
    path = scratch_path(spark, "corpus")
    corpus = tables.documents_corpus(spark, root)
    corpus.select(F.col("corpus_id").alias("_id"), "title", "text").write.json(path)
    return files.read_corpus(spark, path)


def read_queries(spark: SparkSession, root: str) -> Query:
    path = _stored_passages(spark, root)
    return files.read_queries(spark, f"{path}/queries.jsonl", files.read_qrels(spark, f"{path}/qrels/test.tsv"))


def read_qrels(spark: SparkSession, root: str) -> Query:
    return files.read_qrels(spark, f"{_stored_passages(spark, root)}/qrels/test.tsv").select(
        "query_id", "corpus_id", _long("relevance"), "ord"
    )


def nest_qrels(spark: SparkSession, root: str) -> Query:
    return files.nest_qrels(tables.passage_qrels(spark, root, graded=True), NEST_ROWS).select(
        "query_id", _long("part"), _joined("corpus_id").alias("corpus_ids"), _joined("relevance").alias("relevances")
    )


def dataset_counts(spark: SparkSession, root: str) -> Query:
    return files.dataset_counts(tables.passage_collection(spark, root))


def read_generations(spark: SparkSession, root: str) -> Query:
    path = scratch_path(spark, "generations")
    store.write_generations(tables.reply_generations(spark, root), path)
    return store.read_generations(spark, path).withColumn("output", F.element_at("output", 1))


def write_generations(spark: SparkSession, root: str) -> Query:
    path = scratch_path(spark, "generations")
    store.write_generations(tables.reply_generations(spark, root), path)
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("query_id").alias("n_queries"),
        F.sum(F.size("output")).alias("n_texts"),
        F.sum(F.length("gt")).alias("n_chars"),
    )


def _components(vectors: DataFrame) -> DataFrame:
    return (
        vectors.select("id", F.posexplode("embedding").alias("i", "value"))
        .filter(F.col("value") != 0)
        .select("id", _long("i"), _rounded(F.col("value").cast("double")).alias("value"))
    )


def read_embeddings(spark: SparkSession, root: str) -> Query:
    path = scratch_path(spark, "embeddings")
    replies = tables.reply_collection(spark, root).corpus
    store.read_embeddings(spark, path, lambda: dense.encode_vectors(replies, dim=VECTOR_DIM))
    return _components(store.read_embeddings(spark, path))


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(_long("depth"), _long("prev"), _long("token"), _long("n_seq"), _long("n_paths"), "ends")


def write_prefix_index(spark: SparkSession, root: str) -> Query:
    path = scratch_path(spark, "prefix-index")
    prefix.write_prefix_index(prefix.build_prefix_index(_sequences(spark, root)), path)
    return prefix.read_prefix_index(spark, path).groupBy(_long("depth")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("n_seq").alias("n_seq"), F.sum("n_paths").alias("n_paths")
    )


def read_prefix_index(spark: SparkSession, root: str) -> Query:
    path = prefix.index_path(scratch_path(spark, "prefix-index"), "documents", MAX_LENGTH, "flan3b", False)
    build = lambda: prefix.build_prefix_index(_sequences(spark, root))
    prefix.prefix_index(spark, path, build, create=True)
    return _edge_rows(prefix.prefix_index(spark, path, build, create=False))


def _passage_report(spark: SparkSession, root: str) -> DataFrame:
    qrels = tables.passage_qrels(spark, root, graded=True)
    return evaluation.metric_report(_bm25_run(spark, root), qrels)


def write_metrics(spark: SparkSession, root: str) -> Query:
    path = scratch_path(spark, "metrics")
    store.write_metrics(_passage_report(spark, root), path)
    entries = F.explode(F.from_json("value", "map<string,double>")).alias("name", "value")
    return spark.read.text(path).select(entries)


_SETTINGS = {
    "task": "documents",
    "generator": "flan3b",
    "retriever": "bm25",
    "template": "nq",
    "method": "none",
    "num_beams": NUM_BEAMS,
    "max_length": MAX_LENGTH,
    "chunk_corpus": False,
}


def experiment_layout(spark: SparkSession, root: str) -> Query:
    path = scratch_path(spark, "experiments")
    run = _bm25_run(spark, root, TOP).select("query_id", "corpus_id", _long("rank"))
    store.write_experiment(run, path, **_SETTINGS)
    found = store.read_experiment(spark, path, task="documents", retriever="bm25")
    return found.select(
        "query_id", "corpus_id", "rank", *[F.lower(F.col(name).cast("string")).alias(name) for name in store.LAYOUT]
    )


# --- prompts and rewriting ---------------------------------------------------------


def render_prompt(spark: SparkSession, root: str) -> Query:
    return rewriting.render_prompt(tables.passage_queries(spark, root)).select("query_id", "prompt")


def render_prompt_grid(spark: SparkSession, root: str) -> Query:
    return rewriting.render_prompt_grid(tables.passage_queries(spark, root))


def chat_messages(spark: SparkSession, root: str) -> Query:
    return rewriting.chat_messages(tables.passage_queries(spark, root)).select(
        "query_id",
        "stem",
        F.get("messages", F.lit(0))["content"].alias("system"),
        F.get("messages", F.lit(1))["content"].alias("user"),
        "error",
    )


def expand_query(spark: SparkSession, root: str) -> Query:
    replies = tables.reply_collection(spark, root)
    texts = tables.reply_generations(spark, root)
    parts = [
        rewriting.expand_query(replies.queries, replies.qrels, texts, method).select(
            F.lit(method).alias("method"), "query_id", "text"
        )
        for method in ("syn", "syn_q", "q_syn", "none")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def limit_queries(spark: SparkSession, root: str) -> Query:
    """The first hundred queries in the order of a judgement file."""
    replies = tables.reply_collection(spark, root)
    path = scratch_path(spark, "judged")
    files.write_collection(replies, path)
    return rewriting.limit_queries(replies.queries, files.read_qrels(spark, f"{path}/qrels/test.tsv"), 99)


def first_positive(spark: SparkSession, root: str) -> Query:
    passages = tables.passage_collection(spark, root)
    return rewriting.first_positive(passages.qrels, passages.corpus)


def hit_flags(spark: SparkSession, root: str) -> Query:
    run = _bm25_run(spark, root, TOP).select("query_id", "corpus_id", _long("rank"))
    qrels = tables.passage_qrels(spark, root)
    any_hit = rewriting.hit_flags(run, qrels)
    return rewriting.hit_flags(any_hit.withColumnRenamed("hit", "hit_any"), qrels, first_only=True).select(
        "query_id", "corpus_id", "rank", _long("hit_any"), F.col("hit").cast("bigint").alias("hit_first")
    )


def judged_queries(spark: SparkSession, root: str) -> Query:
    return rewriting.judged_queries(tables.passage_queries(spark, root), tables.passage_qrels(spark, root))


# --- tokens and sequences ----------------------------------------------------------


def build_vocab(spark: SparkSession, root: str) -> Query:
    return tokens.build_vocab(tables.documents_corpus(spark, root)).withColumn("token_id", _long("token_id"))


def encode_tokens(spark: SparkSession, root: str) -> Query:
    return _encoded(spark, root)[0].select("corpus_id", _joined("tokens").alias("tokens"))


def truncate_tokens_query(spark: SparkSession, root: str) -> Query:
    return tokens.truncated(_encoded(spark, root)[0]).select("corpus_id", _joined("tokens").alias("tokens"))


def chunk_tokens(spark: SparkSession, root: str) -> Query:
    return tokens.chunked(_encoded(spark, root)[0]).select("corpus_id", _long("chunk"), _joined("tokens").alias("tokens"))


def unchunkable_docs(spark: SparkSession, root: str) -> Query:
    return tokens.unchunkable_docs(_encoded(spark, root)[0]).select("corpus_id", _long("n_tokens"))


def frame_sequences(spark: SparkSession, root: str) -> Query:
    return _sequences(spark, root).select("corpus_id", _joined("tokens").alias("tokens"))


def cut_at_pad_query(spark: SparkSession, root: str) -> Query:
    """Sequences padded to one length, as a batch of generated sequences is."""
    room = F.greatest(F.lit(MAX_LENGTH + 2) - F.size("tokens"), F.lit(1))
    padded = F.concat("tokens", F.array_repeat(F.lit(START_ID), room))
    cut = cut_at_pad(padded)
    return _sequences(spark, root).select(
        "corpus_id", F.size(padded).cast("bigint").alias("n_padded"), _joined(cut).alias("tokens")
    )


def token_length_stats(spark: SparkSession, root: str) -> Query:
    return tokens.token_length_stats(_lengths(spark, root)).select(
        "part", "n_rows", _rounded("mean").alias("mean"), _rounded("median").alias("median"), _rounded("std").alias("std")
    )


def token_length_histogram(spark: SparkSession, root: str) -> Query:
    documents = _lengths(spark, root).filter(F.col("part") == "documents")
    return tokens.token_length_histogram(documents).select(
        _long("bin"), _rounded("left_edge").alias("left_edge"), _rounded("right_edge").alias("right_edge"), "n"
    )


def head_mean_length(spark: SparkSession, root: str) -> Query:
    return tokens.head_mean_length(_docs_with_ids(spark, root), F.col("doc_id"))


# --- generation --------------------------------------------------------------------

# One generator of each style; chat needs a template with a system message and fails without.
REQUESTS = (("chatGPT", "nq"), ("chatGPT", "scifact_hyde"), ("flan3b", "nq"), ("instructGPT", "nq"))


def _requests(spark: SparkSession, root: str, generator: str, stem: str = "nq") -> DataFrame:
    ave_len = tokens.head_mean_length(_docs_with_ids(spark, root), F.col("doc_id"))
    return generation.generation_requests(tables.passage_queries(spark, root), stem, generator, ave_len)


def generation_requests(spark: SparkSession, root: str) -> Query:
    parts = [
        _requests(spark, root, generator, stem).withColumns({"generator": F.lit(generator), "stem": F.lit(stem)})
        for generator, stem in REQUESTS
    ]
    out = functools.reduce(DataFrame.unionByName, parts)
    roles = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "|")
    return out.select(
        "generator", "stem", "query_id", roles.alias("messages"), "error", "prompt", "input_len", "style", "max_tokens", "min_tokens", "do_sample",
        _long("top_k"), "top_p", _long("n_samples"), "temperature",
    )


def echo_generator():
    """A stand-in for a model: numbered echoes of the prompt."""

    def generate(requests: list[dict]) -> list[list[str]]:
        return [[f"{request['prompt']} #{i}" for i in range(int(request["n_samples"]))] for request in requests]

    return generate


def _results(spark: SparkSession, root: str) -> DataFrame:
    return generation.run_generation(_requests(spark, root, "flan3b"), echo_generator)


def run_generation(spark: SparkSession, root: str) -> Query:
    return _results(spark, root).select("query_id", F.array_join("output", "|").alias("output"), "error")


def _assembled(spark: SparkSession, root: str) -> DataFrame:
    passages = tables.passage_collection(spark, root)
    positives = rewriting.first_positive(passages.qrels, passages.corpus)
    return generation.assemble_generations(_results(spark, root), passages.queries, positives)


def assemble_generations(spark: SparkSession, root: str) -> Query:
    return _assembled(spark, root).withColumn("output", F.array_join("output", "|"))


def explode_samples(spark: SparkSession, root: str) -> Query:
    return generation.explode_samples(_assembled(spark, root)).select("query_id", _long("sample"), "text")


# --- prefix index ------------------------------------------------------------------


def build_prefix_index(spark: SparkSession, root: str) -> Query:
    return _edge_rows(prefix.build_prefix_index(_sequences(spark, root)))


def _probes(spark: SparkSession, root: str, sequences: DataFrame, vocab: DataFrame) -> DataFrame:
    """Three beginnings of every document (whole, without the end, half) and every passage."""
    n = F.size("tokens")
    lengths = F.array(n, n - 1, F.floor(n / 2).cast("int"))
    from_docs = sequences.select("corpus_id", "tokens", F.posexplode(lengths).alias("kind", "length")).select(
        F.concat_ws("/", "corpus_id", "kind").alias("probe_id"), F.slice("tokens", F.lit(1), F.col("length")).alias("tokens")
    )
    passages = tokens.encode_tokens(tables.passage_queries(spark, root), vocab, "query_id")
    from_passages = tokens.framed(tokens.truncated(passages)).select(F.col("query_id").alias("probe_id"), "tokens")
    return from_docs.unionByName(from_passages)


def _allowed(spark: SparkSession, root: str) -> DataFrame:
    sequences, vocab = _stored_sequences(spark, root)
    return prefix.next_tokens(prefix.build_prefix_index(sequences), _probes(spark, root, sequences, vocab))


def next_tokens(spark: SparkSession, root: str) -> Query:
    return _allowed(spark, root).select("probe_id", _long("token"))


def next_tokens_policy(spark: SparkSession, root: str) -> Query:
    allowed = cut_lineage(_allowed(spark, root))
    out = [
        prefix.next_tokens_policy(allowed, policy).select(F.lit(policy).alias("policy"), "probe_id", _long("token"))
        for policy in ("pass", "stop")
    ]
    return out[0].unionByName(out[1])


def sequence_documents(spark: SparkSession, root: str) -> Query:
    sequences = _stored_sequences(spark, root)[0].withColumn("ord", F.substring("corpus_id", 2, 20).cast("bigint"))
    outputs = sequences.groupBy("tokens").agg(F.min("ord").alias("sequence_id"))
    out = [
        prefix.sequence_documents(outputs, sequences, which).select(F.lit(which).alias("which"), "sequence_id", "corpus_id")
        for which in ("all", "first")
    ]
    return out[0].unionByName(out[1])


def add_sequences(spark: SparkSession, root: str) -> Query:
    """Replies added to an index of the documents."""
    sequences, vocab = _stored_sequences(spark, root)
    added = _reply_sequences(spark, root, vocab)
    return _edge_rows(prefix.add_sequences(prefix.build_prefix_index(sequences), sequences, added))


def enumerate_sequences(spark: SparkSession, root: str) -> Query:
    return prefix.enumerate_sequences(_sequences(spark, root)).select("corpus_id", _joined("tokens").alias("tokens"))


def index_length(spark: SparkSession, root: str) -> Query:
    return prefix.index_length(_sequences(spark, root))


def append_index(spark: SparkSession, root: str) -> Query:
    """An index of replies, without start ids, behind the end id of an index of documents.

    Probes are whole and half documents, passages, the document before a conversation's
    replies without its end id (all beginnings of replies follow), and that document
    followed by half of each reply (found in the second index).

    Left out: documents without a conversation's reply are not probed without their end id.
    Each such probe is answered by the first ids of all replies, so asking for every
    document would return documents times first ids; ``count_appended`` asks for all.
    """
    sequences, replies, probes = _appended(spark, root, every=False)
    return prefix.append_index(
        prefix.build_prefix_index(sequences), prefix.build_prefix_index(replies), 1, probes
    ).select("probe_id", _long("token"))


def count_appended(spark: SparkSession, root: str) -> Query:
    """How many ids follow each probe of the two indexes, with every document's probe without its end id."""
    sequences, replies, probes = _appended(spark, root, every=True)
    return prefix.count_appended(prefix.build_prefix_index(sequences), prefix.build_prefix_index(replies), 1, probes)


def _appended(spark: SparkSession, root: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, replies without start ids, and probes."""
    sequences, vocab = _stored_sequences(spark, root)
    replies = cut_lineage(tokens.truncated(tokens.encode_tokens(tables.reply_collection(spark, root).corpus, vocab)))
    inside = _probes(spark, root, sequences, vocab)
    if not every:
        inside = inside.filter(~F.col("probe_id").endswith("/1"))
    document = F.concat(F.lit("d"), F.regexp_extract("corpus_id", r"^a(\d+)-", 1))
    before = sequences.select(F.col("corpus_id").alias("document"), F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("before"))
    paired = replies.withColumn("document", document).join(before, "document")
    half = F.slice("tokens", F.lit(1), F.floor(F.size("tokens") / 2).cast("int"))
    beyond = paired.select(F.concat(F.col("corpus_id"), F.lit("/beyond")).alias("probe_id"), F.concat("before", half).alias("tokens"))
    at_end = paired.select(F.concat(F.col("corpus_id"), F.lit("/end")).alias("probe_id"), F.col("before").alias("tokens"))
    return sequences, replies, inside.unionByName(beyond).unionByName(at_end)


def shared_sequences(spark: SparkSession, root: str) -> Query:
    return prefix.shared_sequences(_sequences(spark, root))


def shadowed_documents(spark: SparkSession, root: str) -> Query:
    """Titles and texts in one index without end ids, where a title is the beginning of its text."""
    return prefix.shadowed_documents(_plain_sequences(spark, root)[0])


def prefix_fanout(spark: SparkSession, root: str) -> Query:
    return prefix.prefix_fanout(prefix.build_prefix_index(_sequences(spark, root))).withColumn("depth", _long("depth"))


# --- retrieval ---------------------------------------------------------------------


def zero_fill(spark: SparkSession, root: str) -> Query:
    run, qrels = _bm25_run(spark, root, TOP), tables.passage_qrels(spark, root)
    return evaluation.zero_fill(run, qrels, tables.documents_corpus(spark, root))


def bm25_index(spark: SparkSession, root: str) -> Query:
    path = scratch_path(spark, "bm25-index")
    lexical.write_bm25_index(lexical.bm25_index(tables.documents_corpus(spark, root)), path)
    return lexical.read_bm25_index(spark, path).postings.select("corpus_id", "field", "term", _long("dl"), _long("tf"))


def bm25_search(spark: SparkSession, root: str) -> Query:
    """Search in a stored index: only the folders of the passages' terms are read."""
    path = scratch_path(spark, "bm25-index")
    lexical.write_bm25_index(lexical.bm25_index(tables.documents_corpus(spark, root)), path)
    return _run_rows(lexical.bm25_search(lexical.read_bm25_index(spark, path), tables.passage_queries(spark, root), DEPTH))


def _block_run(spark: SparkSession, root: str, k: int) -> DataFrame:
    path = scratch_path(spark, "bm25-blocks")
    lexical_blocks.write_block_index(tables.documents_corpus(spark, root), path)
    return lexical_blocks.block_search(lexical_blocks.read_block_index(spark, path), tables.passage_queries(spark, root), k)


def bm25_block_search(spark: SparkSession, root: str) -> Query:
    """Search in a stored index with bounds per block, to the depth of the other searches."""
    return _run_rows(_block_run(spark, root, DEPTH))


def bm25_block_top(spark: SparkSession, root: str) -> Query:
    """The same for short lists, where a search leaves out most blocks."""
    return _run_rows(_block_run(spark, root, TOP))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return tables.vector_collection(spark, root).select("id", "embedding")


def _run_rows(run: DataFrame) -> DataFrame:
    # Searches round scores themselves; a second rounding would meet halves.
    return run.select("query_id", "corpus_id", "score", _long("rank"))


def dense_search_dot(spark: SparkSession, root: str) -> Query:
    return _run_rows(dense.dense_search_dot(_vectors(spark, root), _vectors(spark, root), DEPTH))


def dense_search_cosine(spark: SparkSession, root: str) -> Query:
    """Encoded passages against encoded documents."""
    asked = dense.encode_vectors(tables.passage_queries(spark, root), "query_id", VECTOR_DIM)
    given = dense.encode_vectors(tables.documents_corpus(spark, root), "corpus_id", VECTOR_DIM)
    return _run_rows(dense.dense_search_cosine(asked, given, DEPTH))


def dense_search_blocked(spark: SparkSession, root: str) -> Query:
    return _run_rows(dense.dense_search_blocked(_vectors(spark, root), _vectors(spark, root), DEPTH, query_block=256, corpus_block=512))


def encode_vectors(spark: SparkSession, root: str) -> Query:
    return _components(dense.encode_vectors(tables.documents_corpus(spark, root), dim=VECTOR_DIM))


def _beams(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    sequences, vocab = _stored_sequences(spark, root)
    asked = tokens.encode_tokens(tables.passage_queries(spark, root), vocab, "query_id")
    return beam.constrained_beam_search(beam.stored_search_index(sequences), asked), sequences


def constrained_beam_search(spark: SparkSession, root: str) -> Query:
    return _beams(spark, root)[0].select(
        "query_id", _long("rank"), _joined("tokens").alias("tokens"), _rounded("score").alias("score")
    )


def pass_beam_search(spark: SparkSession, root: str) -> Query:
    """Search through complete sequences: titles and texts in one index without end ids."""
    sequences, vocab = _plain_sequences(spark, root)
    asked = tokens.encode_tokens(tables.passage_queries(spark, root), vocab, "query_id")
    found = beam.constrained_beam_search(beam.stored_search_index(sequences, "pass"), asked)
    return found.select("query_id", _long("rank"), _joined("tokens").alias("tokens"), _rounded("score").alias("score"))


def unmatched_beams(spark: SparkSession, root: str) -> Query:
    """Errors of such a search: sequences that are no document's, by a scorer that likes to end."""
    sequences, vocab = _plain_sequences(spark, root)
    asked = tokens.encode_tokens(tables.passage_queries(spark, root), vocab, "query_id")
    likes_to_end = lambda logp, token, _: F.when(token == TERMINAL, 0.0).otherwise(logp)
    found = beam.constrained_beam_search(beam.stored_search_index(sequences, "pass"), asked, scorer=likes_to_end)
    lost = prefix.unmatched_sequences(cut_lineage(found), sequences)
    return lost.select("query_id", _long("rank"), _joined("tokens").alias("tokens"), _rounded("score").alias("score"))


def prefix_scorer():
    """A stand-in for a language model: the score of a step depends on all ids before it."""
    import pyarrow as pa

    def score(batch: pa.RecordBatch) -> pa.Array:
        out = []
        for query, before, label in zip(*(batch.column(c).to_pylist() for c in ("query_tokens", "tokens", "label"))):
            wanted, total, steps = set(query), sum(before), []
            for token in label:
                steps.append(-(((total + 7 * token) % 101) + 1) / 101 + (0.5 if token in wanted else 0.0))
                total += token
            out.append(steps)
        return pa.array(out, pa.list_(pa.float64()))

    return score


def prefix_scored_search(spark: SparkSession, root: str) -> Query:
    """Search with a scorer that sees whole beginnings, in batches."""
    sequences, vocab = _stored_sequences(spark, root)
    asked = tokens.encode_tokens(tables.passage_queries(spark, root), vocab, "query_id")
    found = beam.constrained_beam_search(beam.stored_search_index(sequences), asked, scorer=beam.BatchScorer(prefix_scorer))
    return found.select("query_id", _long("rank"), _joined("tokens").alias("tokens"), _rounded("score").alias("score"))


def beams_to_run(spark: SparkSession, root: str) -> Query:
    beams, sequences = _beams(spark, root)
    return beam.beams_to_run(beams, sequences).select("query_id", "corpus_id", _rounded("score").alias("score"))


def unmatched_sequences(spark: SparkSession, root: str) -> Query:
    """Passages and documents as outputs, looked up among the documents."""
    stored, vocab = _stored_sequences(spark, root)
    passages = tokens.encode_tokens(tables.passage_queries(spark, root), vocab, "query_id", limit=MAX_LENGTH)
    outputs = tokens.framed(tokens.truncated(passages)).select(F.col("query_id").alias("corpus_id"), "tokens")
    outputs = outputs.unionByName(stored.select("corpus_id", "tokens"))
    return prefix.unmatched_sequences(outputs, stored).select("corpus_id", F.size("tokens").cast("bigint").alias("n_tokens"))


def drop_self_matches(spark: SparkSession, root: str) -> Query:
    vectors = _vectors(spark, root)
    run = dense.dense_search_dot(vectors, vectors, TOP).select("query_id", "corpus_id", "score")
    own = vectors.select(F.col("id").alias("query_id"), F.col("id").alias("corpus_id"), F.lit(1.0).alias("score"))
    return evaluation.drop_self_matches(run.unionByName(own))


# --- evaluation --------------------------------------------------------------------


def rank_run(spark: SparkSession, root: str) -> Query:
    """Scores in half steps, so that many documents tie."""
    run = _bm25_run(spark, root).select("query_id", "corpus_id", (F.floor(F.col("score") * 2) / 2).alias("score"))
    return evaluation.rank_run(run).withColumn("rank", _long("rank"))


def _per_query(spark: SparkSession, root: str, metric) -> DataFrame:
    qrels = tables.passage_qrels(spark, root, graded=True)
    return metric(_bm25_run(spark, root), qrels).select("query_id", _long("k"), _rounded("value").alias("value"))


def ndcg_at_k(spark: SparkSession, root: str) -> Query:
    return _per_query(spark, root, evaluation.ndcg_at_k)


def map_at_k(spark: SparkSession, root: str) -> Query:
    return _per_query(spark, root, evaluation.map_at_k)


def recall_at_k(spark: SparkSession, root: str) -> Query:
    return _per_query(spark, root, evaluation.recall_at_k)


def precision_at_k(spark: SparkSession, root: str) -> Query:
    return _per_query(spark, root, evaluation.precision_at_k)


def metric_report(spark: SparkSession, root: str) -> Query:
    return _passage_report(spark, root).withColumn("k", _long("k"))


def _top_hits(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Hit flags of the ten best documents, and the number of judged documents, by query."""
    qrels = tables.passage_qrels(spark, root)
    judged = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_judged"))
    return rewriting.hit_flags(_bm25_run(spark, root, TOP), qrels), judged


def _hit_lists(spark: SparkSession, root: str) -> DataFrame:
    """Ten flags per query against ones for its judged documents, both padded with 0."""
    flags, judged = _top_hits(spark, root)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda x: x["hit"])
    zeros = F.array_repeat(F.lit(0), TOP)
    ones = F.array_repeat(F.lit(1), F.col("n_judged").cast("int"))
    return cut_lineage(
        flags.groupBy("query_id")
        .agg(listed.alias("hits"))
        .join(judged, "query_id")
        .select(
            "query_id",
            F.slice(F.concat("hits", zeros), 1, TOP).alias("predictions"),
            F.slice(F.concat(ones, zeros), 1, TOP).alias("references"),
        )
    )


def _metric_rows(values: DataFrame) -> DataFrame:
    return values.select("metric", _rounded("value").alias("value"))


def list_ndcg(spark: SparkSession, root: str) -> Query:
    rows = _hit_lists(spark, root)
    return _metric_rows(list_metrics.list_ndcg(rows, LIST_KS).unionByName(list_metrics.list_ndcg(rows)))


def query_ndcg(spark: SparkSession, root: str) -> Query:
    flags, judged = _top_hits(spark, root)
    return list_metrics.query_ndcg(flags, judged, 5).select("query_id", _rounded("value").alias("value"))


def list_recall(spark: SparkSession, root: str) -> Query:
    rows = _hit_lists(spark, root)
    return _metric_rows(list_metrics.list_recall(rows, LIST_KS).unionByName(list_metrics.list_recall(rows)))


def list_recall_weighted(spark: SparkSession, root: str) -> Query:
    return _metric_rows(list_metrics.list_recall_weighted(_hit_lists(spark, root), POSITION_WEIGHTS, TOP))


def _neighbour_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of each vector's ten nearest vectors, against its own nearest label repeated.

    The label at a position is compared with that of the neighbour one place nearer, so
    a row holds several classes on both sides.
    """
    vectors = tables.vector_collection(spark, root)
    run = dense.dense_search_dot(vectors, vectors, TOP + 1)
    labelled = run.join(vectors.select(F.col("id").alias("corpus_id"), "label"), "corpus_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])
    lists = labelled.groupBy("query_id").agg(listed.alias("labels")).select(
        "query_id", F.slice("labels", 2, TOP).alias("predictions"), F.slice("labels", 1, TOP).alias("references")
    )
    return cut_lineage(lists)


def list_recall_multiclass(spark: SparkSession, root: str) -> Query:
    rows = _neighbour_labels(spark, root)
    labels = list(range(10))
    parts = [
        list_metrics.list_recall_multiclass(rows, average, TOP, labels if average is None else None).select(
            F.lit(average or "none").alias("average"), "metric", _rounded("value").alias("value")
        )
        for average in ("micro", "macro", "weighted", None)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def list_recall_multiclass_weighted(spark: SparkSession, root: str) -> Query:
    """The same averages, with positions weighted 1, 1/2, 1/3, ..."""
    rows = _neighbour_labels(spark, root)
    parts = [
        list_metrics.list_recall_multiclass(rows, average, TOP, sample_weight=POSITION_WEIGHTS).select(
            F.lit(average).alias("average"), "metric", _rounded("value").alias("value")
        )
        for average in ("micro", "macro", "weighted")
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def list_recall_samples(spark: SparkSession, root: str) -> Query:
    """Sets of labels at each place: the labels of two neighbours, against one of them and the place's number."""

    def sets(of_place) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(TOP - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(TOP - 1)), lambda c: F.when(of_place(i, c), 1).otherwise(0)))

    p, r = F.col("predictions"), F.col("references")
    rows = _neighbour_labels(spark, root).select(
        sets(lambda i, c: (F.get(p, i) == c) | (F.get(p, (i + 1) % TOP) == c)).alias("predictions"),
        sets(lambda i, c: (F.get(r, i) == c) | (i == c)).alias("references"),
    )
    plain = list_metrics.list_recall_samples(rows, TOP).withColumn("weights", F.lit("none"))
    weighted = list_metrics.list_recall_samples(rows, TOP, sample_weight=POSITION_WEIGHTS).withColumn("weights", F.lit("position"))
    return plain.unionByName(weighted).select("weights", "metric", _rounded("value").alias("value"))


# --- experiments -------------------------------------------------------------------


def _report_rows(report: DataFrame) -> DataFrame:
    return report.select("metric", _long("k"), "value")


def lexical_experiment(spark: SparkSession, root: str) -> Query:
    """Do queries find their reply once they were expanded with its text?"""
    replies = tables.reply_collection(spark, root)
    return _report_rows(
        experiments.retrieval_experiment(replies, tables.reply_generations(spark, root), "q_syn", "bm25")
    )


def dense_experiment(spark: SparkSession, root: str) -> Query:
    passages = tables.passage_collection(spark, root)
    return _report_rows(experiments.retrieval_experiment(passages, retriever="contriever", k=1000))


def constrained_experiment(spark: SparkSession, root: str) -> Query:
    return _report_rows(experiments.constrained_experiment(tables.passage_collection(spark, root)))


def chunked_experiment(spark: SparkSession, root: str) -> Query:
    """The same search over the whole chunks of the documents."""
    return _report_rows(experiments.constrained_experiment(tables.passage_collection(spark, root), chunk=True))


def first_document_experiment(spark: SparkSession, root: str) -> Query:
    """nDCG of single documents found by generation, and the number of generated errors."""
    order = F.substring("corpus_id", 2, 20).cast("bigint")
    report, errors = experiments.first_document_experiment(tables.passage_collection(spark, root), order)
    lost = errors.agg(F.lit("errors").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
    return _metric_rows(report.unionByName(lost))


def generation_experiment(spark: SparkSession, root: str) -> Query:
    """Generate for judged queries: outcome of each."""
    passages = tables.passage_collection(spark, root)
    order = F.substring("corpus_id", 2, 20).cast("bigint")
    done, failed = experiments.generation_job(passages, echo_generator, "nq", "flan3b", order)
    return done.select("query_id", "corpus_id", F.size("output").cast("bigint").alias("n_texts"), F.lit(None).cast("string").alias("error")).unionByName(
        failed.select("query_id", F.lit(None).cast("string").alias("corpus_id"), F.lit(0).cast("bigint").alias("n_texts"), "error")
    )


QUERIES = {
    "read_corpus": read_corpus,
    "read_queries": read_queries,
    "read_qrels": read_qrels,
    "nest_qrels": nest_qrels,
    "dataset_counts": dataset_counts,
    "read_generations": read_generations,
    "write_generations": write_generations,
    "read_embeddings": read_embeddings,
    "write_prefix_index": write_prefix_index,
    "read_prefix_index": read_prefix_index,
    "write_metrics": write_metrics,
    "experiment_layout": experiment_layout,
    "render_prompt": render_prompt,
    "render_prompt_grid": render_prompt_grid,
    "chat_messages": chat_messages,
    "expand_query": expand_query,
    "limit_queries": limit_queries,
    "first_positive": first_positive,
    "hit_flags": hit_flags,
    "judged_queries": judged_queries,
    "build_vocab": build_vocab,
    "encode_tokens": encode_tokens,
    "truncate_tokens": truncate_tokens_query,
    "chunk_tokens": chunk_tokens,
    "unchunkable_docs": unchunkable_docs,
    "frame_sequences": frame_sequences,
    "cut_at_pad": cut_at_pad_query,
    "token_length_stats": token_length_stats,
    "token_length_histogram": token_length_histogram,
    "head_mean_length": head_mean_length,
    "generation_requests": generation_requests,
    "run_generation": run_generation,
    "assemble_generations": assemble_generations,
    "explode_samples": explode_samples,
    "build_prefix_index": build_prefix_index,
    "next_tokens": next_tokens,
    "next_tokens_policy": next_tokens_policy,
    "sequence_documents": sequence_documents,
    "add_sequences": add_sequences,
    "enumerate_sequences": enumerate_sequences,
    "index_length": index_length,
    "append_index": append_index,
    "count_appended": count_appended,
    "shared_sequences": shared_sequences,
    "shadowed_documents": shadowed_documents,
    "prefix_fanout": prefix_fanout,
    "zero_fill": zero_fill,
    "bm25_index": bm25_index,
    "bm25_search": bm25_search,
    "bm25_block_search": bm25_block_search,
    "bm25_block_top": bm25_block_top,
    "dense_search_dot": dense_search_dot,
    "dense_search_cosine": dense_search_cosine,
    "dense_search_blocked": dense_search_blocked,
    "encode_vectors": encode_vectors,
    "constrained_beam_search": constrained_beam_search,
    "pass_beam_search": pass_beam_search,
    "prefix_scored_search": prefix_scored_search,
    "unmatched_beams": unmatched_beams,
    "beams_to_run": beams_to_run,
    "unmatched_sequences": unmatched_sequences,
    "drop_self_matches": drop_self_matches,
    "rank_run": rank_run,
    "ndcg_at_k": ndcg_at_k,
    "map_at_k": map_at_k,
    "recall_at_k": recall_at_k,
    "precision_at_k": precision_at_k,
    "metric_report": metric_report,
    "list_ndcg": list_ndcg,
    "query_ndcg": query_ndcg,
    "list_recall": list_recall,
    "list_recall_multiclass": list_recall_multiclass,
    "list_recall_weighted": list_recall_weighted,
    "list_recall_multiclass_weighted": list_recall_multiclass_weighted,
    "list_recall_samples": list_recall_samples,
    "lexical_experiment": lexical_experiment,
    "dense_experiment": dense_experiment,
    "constrained_experiment": constrained_experiment,
    "chunked_experiment": chunked_experiment,
    "first_document_experiment": first_document_experiment,
    "generation_experiment": generation_experiment,
}
