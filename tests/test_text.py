import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import tokens as tk
from rankloom.functions.fixed import GENERATORS, TEMPLATES
from rankloom.functions.text import fill_prompt, whitespace_tokens, word_tokens
from rankloom.operators import generation, rewriting
from rankloom.operators import tokens as ops
from rankloom.operators.ordering import number_all, number_within, top_k

TEXTS = "corpus_id string, text string"


def test_fixed_tables():
    assert len(TEMPLATES) == 20 and len(GENERATORS) == 10
    assert [t[0] for t in TEMPLATES if t[2]] == ["dbpedia-entity_hyde", "scifact_hyde", "trec-covid_hyde"]
    assert all(t[3].count("[QUERY]") == 1 for t in TEMPLATES)


@pytest.mark.parametrize("text", ["costs $1 \\ {x}", "", "again [QUERY]", "a.b*"])
def test_prompts_take_text_literally(spark, text):
    template = "Q: [QUERY] [QUERY]\n"
    got = spark.createDataFrame([(text,)], "t string").select(fill_prompt(F.lit(template), F.col("t"))).first()[0]
    assert got == template.replace("[QUERY]", text)


def test_tokens(spark):
    row = spark.createDataFrame([(" Ab\n\tç, x-1  ",)], "t string").select(
        whitespace_tokens(F.col("t")).alias("s"), word_tokens(F.col("t")).alias("w")
    ).first()
    assert row["s"] == ["ab", "ç,", "x-1"] and row["w"] == ["ab", "ç", "x", "1"]


def test_vocabulary_and_encoding(spark, monkeypatch):
    corpus = spark.createDataFrame([("a", "b a b"), ("b", "c b"), ("c", ""), ("d", "x" * 60 + " a")], TEXTS)
    vocab = ops.build_vocab(corpus)
    got = {r["token"]: (r["token_id"], r["n"], r["df"]) for r in vocab.collect()}
    assert got == {"b": (3, 3, 2), "a": (4, 2, 2), "c": (5, 1, 1), "x" * 60: (6, 1, 1)}
    asked = corpus.union(spark.createDataFrame([("e", "new b")], TEXTS))
    want = {"a": [3, 4, 3], "b": [5, 3], "c": [], "d": [6, 4], "e": [2, 3]}
    for head in (400_000, 1):
        # With a head of one token most tokens take the way of the rare ones.
        monkeypatch.setattr(ops, "_HEAD_TOKENS", head)
        assert {r["corpus_id"]: r["tokens"] for r in ops.encode_tokens(asked, vocab).collect()} == want


def test_sequences_around_the_limit(spark):
    sizes = [0, 3, 4, 5, 8]
    encoded = spark.createDataFrame([(f"d{n}", list(range(10, 10 + n))) for n in sizes], "corpus_id string, tokens array<int>")
    cut = {r["corpus_id"]: r["tokens"] for r in ops.framed(ops.truncated(encoded, 4)).collect()}
    assert cut == {
        "d0": [0, 1], "d3": [0, 10, 11, 12, 1], "d4": [0, 10, 11, 12, 1], "d5": [0, 10, 11, 12, 1], "d8": [0, 10, 11, 12, 1]
    }
    chunks = sorted((r["corpus_id"], r["chunk"], r["tokens"]) for r in ops.chunked(encoded, 4).collect())
    assert chunks == [
        ("d3", 0, [10, 11, 12, 1]), ("d4", 0, [10, 11, 12, 13]), ("d5", 0, [10, 11, 12, 13]),
        ("d8", 0, [10, 11, 12, 13]), ("d8", 1, [14, 15, 16, 17]),
    ]
    assert [r["corpus_id"] for r in ops.unchunkable_docs(encoded, 4).collect()] == ["d0"]
    capped = ops.chunked(encoded, 2, cap=4).filter("corpus_id = 'd8'").orderBy("chunk").collect()
    assert [r["tokens"] for r in capped] == [[10, 11], [12, 1]]


@pytest.mark.parametrize("ids, want", [([0, 5, 6, 0, 7], [0, 5, 6]), ([0, 5], [0, 5]), ([0], [0]), ([0, 0, 5], [0]), ([5, 6, 0], [5, 6])])
def test_cut_at_pad(spark, ids, want):
    assert spark.createDataFrame([(ids,)], "t array<int>").select(tk.cut_at_pad(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("lengths", [[5, 5, 5], [1, 2, 3, 41], [7], list(range(0, 21)), [3, 9, 2048, 17, 17, 100]])
def test_histogram_and_stats(spark, lengths):
    df = spark.createDataFrame([("x", n) for n in lengths], "part string, length int")
    got = ops.token_length_histogram(df).orderBy("bin").collect()
    counts, edges = np.histogram(lengths, bins=20)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["left_edge"] for r in got] + [got[-1]["right_edge"]] == pytest.approx(edges.tolist())
    stats = ops.token_length_stats(df).first()
    assert (stats["mean"], stats["median"], stats["std"]) == pytest.approx((np.mean(lengths), np.median(lengths), np.std(lengths)))


def test_head_mean_length(spark):
    corpus = spark.createDataFrame([("b", "x y z"), ("a", "x"), ("c", "x x x x x")], TEXTS)
    assert ops.head_mean_length(corpus, F.col("corpus_id"), 2).first()["ave_len"] == 3
    assert ops.head_mean_length(corpus, F.col("corpus_id")).first()["ave_len"] == 4


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    numbered = number_all(df, [F.desc("v")], "n", 5).collect()
    assert {r["n"]: r["v"] for r in numbered} == {5 + i: 999 - i for i in range(1000)}
    inside = number_within(df.withColumn("block", F.floor(F.col("v") / 100)), ["key"], ["block"], ["v"], "n").filter("key = 0")
    values = sorted(r["v"] for r in df.filter("key = 0").collect())
    assert {r["n"]: r["v"] for r in inside.collect()} == {i + 1: v for i, v in enumerate(values)}


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k(spark, k):
    df = spark.range(4000).select(F.lit("q").alias("query_id"), F.col("id").cast("string").alias("corpus_id"), (F.col("id") % 500).alias("score"))
    got = [r["corpus_id"] for r in top_k(df, "query_id", [F.desc("score"), F.desc("corpus_id")], k).orderBy("rank").collect()]
    want = sorted((r for r in df.collect()), key=lambda r: (r["score"], r["corpus_id"]), reverse=True)
    assert got == [r["corpus_id"] for r in want[:k]]


QUERIES = "query_id string, text string"
QRELS = "query_id string, corpus_id string, relevance int, ord long"
MADE = "query_id string, corpus_id string, query string, gt string, output array<string>"


@pytest.fixture(scope="module")
def expansion(spark):
    queries = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "three")], QUERIES)
    qrels = spark.createDataFrame([("1", "a", 0, 1), ("1", "b", 1, 2), ("2", "a", 1, 1)], QRELS)
    made = spark.createDataFrame([("1", "a", "one", "g", ["S1", "S2"])], MADE)
    return queries, qrels, made


def test_expansion(expansion):
    queries, qrels, made = expansion
    texts = lambda df: {r["query_id"]: r["text"] for r in df.collect()}
    expand = lambda method: texts(rewriting.expand_query(queries, qrels, made, method, "drop"))
    assert expand("syn") == {"1": "S1"} and expand("syn_q") == {"1": "S1one"} and expand("q_syn") == {"1": "oneS1"}
    assert expand("const_gen") == {"1": "one", "2": "two", "3": "three"}
    with pytest.raises(Exception, match="no synthetic text for query 2"):
        rewriting.expand_query(queries, qrels, made, "syn").collect()


def test_limits_positives_and_flags(spark, expansion, rows):
    queries, qrels, _ = expansion
    # In the order of the first judgements, not of the ids.
    judged = spark.createDataFrame([("3", 1), ("10", 2), ("3", 3), ("2", 4)], "query_id string, place int")
    asked = spark.createDataFrame([("2", "b"), ("3", "c"), ("10", "d"), ("11", "e")], "query_id string, text string")
    assert rows(rewriting.limit_queries(asked, judged, 1)) == [("10", "d"), ("3", "c")]
    assert rewriting.limit_queries(asked, judged).count() == 3
    corpus = spark.createDataFrame([("a", "", "ta"), ("b", "", "tb")], "corpus_id string, title string, text string")
    assert rows(rewriting.first_positive(qrels, corpus)) == [("1", "a", "ta"), ("2", "a", "ta")]
    run = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "c")], "query_id string, corpus_id string")
    assert rows(rewriting.hit_flags(run, qrels)) == [("1", "a", 1), ("1", "b", 1), ("1", "c", 0)]
    assert rows(rewriting.hit_flags(run, qrels, True)) == [("1", "a", 1), ("1", "b", 0), ("1", "c", 0)]


def test_generation_records_failures(spark, rows):
    def make():
        def generate(requests):
            if any(r["prompt"] == "bad" for r in requests):
                raise RuntimeError("no")
            return [[r["prompt"] + "!"] for r in requests]

        return generate

    requests = spark.createDataFrame([("1", "x"), ("2", "bad"), ("3", "y")], "query_id string, prompt string")
    results = generation.run_generation(requests, make, partitions=1)
    assert rows(results) == [("1", ["x!"], None), ("2", None, "RuntimeError: no"), ("3", ["y!"], None)]
    queries = spark.createDataFrame([("1", "t1"), ("2", "t2"), ("3", "t3")], QUERIES)
    positives = spark.createDataFrame([("1", "a", "g1"), ("2", "a", "g1")], "query_id string, corpus_id string, gt string")
    twice = results.withColumn("n", F.lit(1)).unionByName(
        spark.createDataFrame([("1", ["later"], None, 2)], "query_id string, output array<string>, error string, n int")
    )
    assert rows(generation.assemble_generations(twice, queries, positives, "n")) == [("1", "a", "t1", "g1", ["later"])]
