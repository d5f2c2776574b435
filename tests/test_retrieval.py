import collections
import glob
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import dense, lexical, lexical_blocks
from rankloom.session import recorded_steps
from rankloom.sources import collection as files
from rankloom.sources import store
from rankloom.sources.tables import containing_documents

VECTORS = "id string, embedding array<float>"


def _vectors(n, dim, seed):
    dice = np.random.default_rng(seed)
    values = dice.normal(size=(n, dim)).astype(np.float32) * dice.uniform(0.5, 3.0, size=(n, 1)).astype(np.float32)
    values[n // 2] = values[0]
    values[n // 3] = 0
    return [(f"v{i}", [float(x) for x in row]) for i, row in enumerate(values)]


def _exhaustive(queries, corpus, k, score):
    out = {}
    for qid, q in queries:
        q = np.array(q, dtype=np.float64)
        scored = []
        for cid, c in corpus:
            c = np.array(c, dtype=np.float64)
            if score == "cos_sim":
                both = np.linalg.norm(q) * np.linalg.norm(c)
                value = q @ c / both if both else 0.0
            else:
                value = q @ c
            if cid != qid:
                scored.append((round(float(value), 6) + 0.0, cid))
        out[qid] = [cid for _, cid in sorted(scored, reverse=True)[:k]]
    return out


def _lists(run):
    out = collections.defaultdict(list)
    for r in run.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["corpus_id"])
    return dict(out)


@pytest.mark.parametrize("score", ["dot", "cos_sim"])
@pytest.mark.parametrize("blocked", [None, False, True])
def test_dense_search_is_exact(spark, score, blocked):
    corpus, queries = _vectors(90, 8, 1), _vectors(25, 8, 2)
    run = dense.dense_search(
        spark.createDataFrame(queries, VECTORS), spark.createDataFrame(corpus, VECTORS).repartition(5), 7, score, blocked, 10, 20
    )
    assert _lists(run) == _exhaustive(queries, corpus, 7, score)


@pytest.mark.parametrize("values", [16_000_000, 100])
def test_grid_of_a_table_with_itself(spark, monkeypatch, values):
    vectors = _vectors(90, 8, 4)
    monkeypatch.setattr(dense, "_GROUP_VALUES", values)
    monkeypatch.setattr(dense, "_PRODUCT_CELLS", 200)
    both = spark.createDataFrame(vectors, VECTORS).repartition(3)
    assert _lists(dense.dense_search(both, both, 7, "dot", True, 10, 12)) == _exhaustive(vectors, vectors, 7, "dot")


def test_grid_sends_each_vector_once_per_group(spark):
    vectors = spark.createDataFrame(_vectors(200, 8, 5), VECTORS)
    found = dense._by_grid(vectors, vectors, 3, "dot", 8, 8)
    groups = found.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert groups == 3  # the lists of all blocks of the corpus were merged in the task


def test_dense_search_with_many_copies(spark):
    corpus = [(f"c{i:03d}", [1.0, 0.0]) for i in range(200)] + [("z", [2.0, 0.0]), ("none", None)]
    run = dense.dense_search(spark.createDataFrame([("q", [1.0, 0.0])], VECTORS), spark.createDataFrame(corpus, VECTORS), 3)
    assert _lists(run) == {"q": ["z", "c199", "c198"]}


def test_own_encoder_takes_the_place(spark):
    @F.pandas_udf("array<float>")
    def lengths(texts):
        return texts.map(lambda t: [float(len(t)), 1.0])

    texts = spark.createDataFrame([("a", "xyz"), ("b", "")], "corpus_id string, text string")
    got = {r["id"]: r["embedding"] for r in dense.encode_vectors(texts, encode=lengths).collect()}
    assert got == {"a": [3.0, 1.0], "b": [0.0, 1.0]}
    built_in = {r["id"]: r["embedding"] for r in dense.encode_vectors(texts, dim=16).collect()}
    assert sum(v * v for v in built_in["a"]) == pytest.approx(1) and set(built_in["b"]) == {0.0}


def _bm25(corpus, queries, k, tie=0.5, k1=1.2, b=0.75):
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    out = {}
    fields = {f: {d[0]: words(d[i]) for d in corpus if words(d[i])} for f, i in (("title", 1), ("text", 2))}
    for qid, text in queries:
        scored = []
        for doc in corpus:
            parts = []
            for docs in fields.values():
                terms = docs.get(doc[0], [])
                mean = sum(map(len, docs.values())) / max(len(docs), 1)
                total = 0.0
                for w in words(text):
                    df, tf = sum(w in d for d in docs.values()), terms.count(w)
                    if tf:
                        total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(terms) / mean))
                parts.append(total)
            value = max(parts) + tie * (sum(parts) - max(parts))
            if any(parts) and doc[0] != qid:
                scored.append((round(value, 6), doc[0]))
        out[qid] = [d for _, d in sorted(scored, reverse=True)[:k]]
    return {q: ds for q, ds in out.items() if ds}


@pytest.mark.parametrize("few", [True, False])
def test_bm25_is_exact(spark, tmp_path, monkeypatch, few):
    dice = random.Random(3)
    word = lambda: dice.choice("a b c d e f g h".split())
    text = lambda n: " ".join(word() for _ in range(n))
    corpus = [(f"d{i}", text(dice.randint(0, 3)), text(dice.randint(0, 12))) for i in range(40)]
    corpus.append(("q0", "a", "a b"))
    queries = [(f"q{i}", text(dice.randint(0, 4))) for i in range(6)] + [("q9", "a, A; a! zzz")]
    monkeypatch.setattr(lexical, "fits", lambda df: few)
    index = lexical.bm25_index(spark.createDataFrame(corpus, "corpus_id string, title string, text string"))
    asked = spark.createDataFrame(queries, "query_id string, text string")
    want = _bm25(corpus, queries, 5)
    assert _lists(lexical.bm25_search(index, asked, 5)) == want
    lexical.write_bm25_index(index, str(tmp_path), buckets=3)
    assert _lists(lexical.bm25_search(lexical.read_bm25_index(spark, str(tmp_path)), asked, 5)) == want


@pytest.mark.parametrize("sizes", [(1, 1, 1, 1), (1000, 1000, 3, 7), (30, 20, 2, 5)])
def test_bm25_by_products_is_exact(spark, monkeypatch, sizes):
    dice = random.Random(8)
    text = lambda n: " ".join(dice.choice("a b c d e f g h i j".split()) for _ in range(n))
    corpus = [(f"d{i}", text(dice.randint(0, 3)), text(dice.randint(0, 12))) for i in range(60)] + [("q0", "a", "a b")]
    queries = [(f"q{i}", text(dice.randint(0, 6))) for i in range(9)] + [("q9", "a, A; a! zzz"), (None, "a")]
    monkeypatch.setattr(lexical, "_JOINED_TERMS", 0)
    for name, size in zip(("_QUERY_CELLS", "_DOC_CELLS", "_QUERY_TILE", "_DOC_TILE"), sizes):
        monkeypatch.setattr(lexical, name, size)
    index = lexical.bm25_index(spark.createDataFrame(corpus, "corpus_id string, title string, text string"))
    run = lexical.bm25_search(index, spark.createDataFrame(queries, "query_id string, text string"), 5)
    assert _lists(run) == _bm25(corpus, queries[:-1], 5)


def test_bm25_tasks_grow_with_the_corpus(spark, monkeypatch):
    corpus = spark.createDataFrame([(f"d{i}", "", "a b c") for i in range(40)], "corpus_id string, title string, text string")
    asked = spark.createDataFrame([("q", "a b")], "query_id string, text string")
    monkeypatch.setattr(lexical, "TASK_TOKENS", 6)
    plan = lexical.bm25_search(lexical.bm25_index(corpus), asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [corpus_id" in plan and ", 20" in plan


def test_bm25_deals_texts_and_not_their_terms(spark):
    """A task that writes to more than 200 partitions holds its rows, which were all occurrences of a split."""
    corpus = spark.createDataFrame([(f"d{i}", "", "a b c") for i in range(40)], "corpus_id string, title string, text string")
    asked = spark.createDataFrame([("q", "a b")], "query_id string, text string")
    plan = lexical.bm25_search(lexical.bm25_index(corpus), asked, 5)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depths = [re.search("[A-Za-z]", line).start() for line in plan]
    dealt = [i for i, line in enumerate(plan) if "RepartitionByExpression [corpus_id" in line]
    assert dealt
    for i in dealt:
        below = itertools.takewhile(lambda j: depths[j] > depths[i], range(i + 1, len(plan)))
        assert not any("Generate" in plan[j] for j in below)


def test_bm25_streams_texts_to_few_partitions_before_many(spark, monkeypatch):
    """The task of a row group dealt to more partitions than Spark streams to held all its texts."""
    corpus = [(f"d{i}", "", "a b c " * (i % 3)) for i in range(60)]
    asked = [("q", "a b")]
    monkeypatch.setattr(lexical, "TASK_TOKENS", 6)
    monkeypatch.setattr(lexical, "_STREAMED", 5)
    index = lexical.bm25_index(spark.createDataFrame(corpus, "corpus_id string, title string, text string"))
    run = lexical.bm25_search(index, spark.createDataFrame(asked, "query_id string, text string"), 5)
    assert _lists(run) == _bm25(corpus, asked, 5)
    plan = run._jdf.queryExecution().optimizedPlan().toString().splitlines()
    exchanges = [line.rsplit(", ", 1)[1].strip() for line in plan if "RepartitionByExpression" in line]
    assert exchanges == ["30", "5"] * (len(exchanges) // 2) and exchanges


@pytest.mark.parametrize("few, k, block_docs", [(True, 3, 1), (False, 5, 4), (True, 60, 4)])
def test_block_search_is_exact(spark, tmp_path, monkeypatch, few, k, block_docs):
    dice = random.Random(k)
    word = lambda: f"w{min(int(dice.expovariate(0.2)), 30)}"
    text = lambda n: " ".join(word() for _ in range(n))
    corpus = [(f"d{i}", text(dice.randint(0, 3)), text(dice.randint(0, 25))) for i in range(120)]
    corpus += [("q0", "w1", "w1 w2"), ("empty", None, None), (None, "w1", "w2"), *[(f"copy{i}", "w3", "w4 w5 w6") for i in range(9)]]
    queries = [(f"q{i}", text(dice.randint(0, 6))) for i in range(8)] + [("q9", "w1, W1; w1! zzz"), ("none", None), ("ties", "w4 w5")]
    monkeypatch.setattr(lexical_blocks, "fits", lambda df: few)
    asked = spark.createDataFrame(queries, "query_id string, text string")
    lexical_blocks.write_block_index(
        spark.createDataFrame(corpus, "corpus_id string, title string, text string"), str(tmp_path), buckets=3, block_docs=block_docs
    )
    index = lexical_blocks.read_block_index(spark, str(tmp_path))
    known = [(c, t or "", x or "") for c, t, x in corpus if c is not None]
    want = _bm25(known, [(q, t or "") for q, t in queries], k)
    assert _lists(lexical_blocks.block_search(index, asked, k)) == want
    shares = {r["query_id"]: (r["n_matched"], r["n_scored"]) for r in lexical_blocks.block_shares(index, asked, k).collect()}
    assert all(len(want[q]) <= scored <= matched for q, (matched, scored) in shares.items())
    if k < 60:
        assert sum(s for _, s in shares.values()) < sum(m for m, _ in shares.values())


@pytest.mark.parametrize("sizes", [(1, 1, 2, 3), (50, 4, 512, 8192)])
def test_block_search_joins_no_query_with_postings(spark, tmp_path, monkeypatch, sizes):
    """Blocks that are left are scored as products in groups of bounded size, not as a row per query, document and term."""
    dice = random.Random(4)
    text = lambda n: " ".join(f"w{min(int(dice.expovariate(0.2)), 30)}" for _ in range(n))
    corpus = [(f"d{i}", text(dice.randint(0, 3)), text(dice.randint(0, 25))) for i in range(150)]
    queries = [(f"q{i}", text(dice.randint(1, 6))) for i in range(9)]
    for name, size in zip(("GROUP_POSTINGS", "GROUP_PAIRS", "_QUERY_TILE", "_DOC_TILE"), sizes):
        monkeypatch.setattr(lexical_blocks, name, size)
    lexical_blocks.write_block_index(spark.createDataFrame(corpus, "corpus_id string, title string, text string"), str(tmp_path), block_docs=2)
    asked = spark.createDataFrame(queries, "query_id string, text string")
    run = lexical_blocks.block_search(lexical_blocks.read_block_index(spark, str(tmp_path)), asked, 3)
    assert "FlatMapCoGroupsInArrow" in run._jdf.queryExecution().optimizedPlan().toString()
    assert _lists(run) == _bm25(corpus, queries, 3)


def test_a_block_index_leaves_its_tables_only(spark, tmp_path):
    """All postings stayed beside the index as a step, as did what was shuffled to sort them."""
    corpus = spark.createDataFrame([(f"d{i}", "", f"x w{i % 5}") for i in range(40)], "corpus_id string, title string, text string")
    with recorded_steps() as steps:
        lexical_blocks.write_block_index(corpus, str(tmp_path / "blocks"))
    left = [spark.read.parquet(step).columns for step in steps if glob.glob(f"{step}/*.parquet")]
    assert steps and not any("factor" in columns for columns in left)


def test_the_grid_shuffles_its_lists_once(spark, monkeypatch):
    """The lists of all groups of documents were shuffled by slices first, and cut to nothing less there."""
    monkeypatch.setattr(lexical, "_JOINED_TERMS", 0)
    corpus = spark.createDataFrame([(f"d{i}", "", f"a w{i}") for i in range(40)], "corpus_id string, title string, text string")
    run = lexical.bm25_search(lexical.bm25_index(corpus), spark.createDataFrame([("q", "a w3")], "query_id string, text string"), 5)
    plan = run._jdf.queryExecution().executedPlan().toString()
    above = plan.split("FlatMapCoGroupsInArrow")[0]
    assert above.count("Exchange hashpartitioning") == 1
    assert [r["corpus_id"] for r in run.orderBy("rank").collect()] == ["d3", "d9", "d8", "d7", "d6"]


def test_block_search_counts_repeated_ids_as_one_document(spark, tmp_path):
    corpus = [("a", "", "x y"), ("a", "", "x z z"), ("b", "", "x x x"), *[(f"n{i}", "", "x w w w w") for i in range(20)]]
    docs = spark.createDataFrame(corpus, "corpus_id string, title string, text string")
    asked = spark.createDataFrame([("q", "x")], "query_id string, text string")
    lexical_blocks.write_block_index(docs, str(tmp_path), block_docs=2)
    got = lexical_blocks.block_search(lexical_blocks.read_block_index(spark, str(tmp_path)), asked, 2)
    want = lexical.bm25_search(lexical.bm25_index(docs), asked, 2)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [tuple(r) for r in want.orderBy("rank").collect()]


def test_block_search_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "corpus_id string, title string, text string")
    asked = spark.createDataFrame([("q", "x")], "query_id string, text string")
    lexical_blocks.write_block_index(none, str(tmp_path / "none"))
    assert lexical_blocks.block_search(lexical_blocks.read_block_index(spark, str(tmp_path / "none")), asked, 2).count() == 0
    some = spark.createDataFrame([("a", "", "x")], "corpus_id string, title string, text string")
    lexical_blocks.write_block_index(some, str(tmp_path / "some"))
    assert lexical_blocks.block_search(lexical_blocks.read_block_index(spark, str(tmp_path / "some")), asked.limit(0), 2).count() == 0


def test_containment_equals_scan(spark, rows):
    docs = [(1, "the cat\nsat  on the mat"), (2, "the cat sat"), (3, "cat"), (4, "concat sat on"), (5, "")]
    items = [(1, "cat sat"), (2, "the"), (3, "sat on"), (4, "dog"), (5, " "), (6, "the cat")]
    got = containing_documents(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    norm = lambda t: " " + " ".join(t.split()) + " "
    want = sorted((d, i) for d, t in docs for i, p in items if p.strip() and norm(p) in norm(t))
    assert rows(got) == want


def test_collection_round_trip(spark, tmp_path, rows):
    made = files.Collection(
        spark.createDataFrame([("d1", "t\t1", 'a "b"\nc'), ("d2", None, "x")], "corpus_id string, title string, text string"),
        spark.createDataFrame([("q1", "one"), ("q2", "two")], "query_id string, text string"),
        spark.createDataFrame([("q1", "d9", 2, 1), ("q1", "d1", 0, 2), ("q1", "d5", 1, 3)], "query_id string, corpus_id string, relevance int, ord long"),
    )
    files.write_collection(made, str(tmp_path))
    back = files.read_collection(spark, str(tmp_path))
    assert rows(back.corpus) == [("d1", "t\t1", 'a "b"\nc'), ("d2", "", "x")]
    assert rows(back.queries) == [("q1", "one")]
    assert rows(back.qrels.drop("place")) == rows(made.qrels)
    assert rows(files.nest_qrels(back.qrels)) == [("q1", 0, ["d9", "d1", "d5"], [2, 0, 1])]
    assert rows(files.nest_qrels(back.qrels, 2)) == [("q1", 0, ["d9", "d1"], [2, 0]), ("q1", 1, ["d5"], [1])]
    assert rows(files.dataset_counts(back)) == [("corpus", 2), ("qrels", 1), ("queries", 1)]


def test_qrels_keep_the_order_of_their_files(spark, tmp_path):
    (tmp_path / "test.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"q{i % 3}\td{99 - i}\t1\n" for i in range(99)))
    got = collections.defaultdict(list)
    for r in files.read_qrels(spark, str(tmp_path / "test.tsv")).orderBy("query_id", "ord").collect():
        got[r["query_id"]].append((r["ord"], r["corpus_id"]))
    assert got["q1"] == [(n + 1, f"d{99 - i}") for n, i in enumerate(range(1, 99, 3))]


def test_stores(spark, tmp_path, rows):
    made = spark.createDataFrame([("q", "d", "t", "g", ["s1", "s2"])], "query_id string, corpus_id string, query string, gt string, output array<string>")
    path = str(tmp_path / "g")
    assert store.read_generations(spark, path) is None
    store.write_generations(made, path)
    assert rows(store.read_generations(spark, path)) == rows(made)
    calls = []
    build = lambda: calls.append(1) or spark.createDataFrame([("a", [1.0])], VECTORS)
    for _ in range(2):
        assert rows(store.read_embeddings(spark, str(tmp_path / "e"), build)) == [("a", [1.0])]
    assert len(calls) == 1
    with pytest.raises(FileNotFoundError):
        store.read_embeddings(spark, str(tmp_path / "none"))


def test_metric_lines_and_layout(spark, tmp_path):
    values = [(m, k, k / 1000) for m in ("P", "NDCG", "Recall", "MAP") for k in (10, 1, 100)]
    report = spark.createDataFrame(values, "metric string, k int, value double")
    store.write_metrics(report, str(tmp_path / "m"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert [line[:8] for line in lines] == ['{"NDCG@1', '{"MAP@1"', '{"Recall', '{"P@1":0']
    assert lines[1] == '{"MAP@1":0.001,"MAP@10":0.01,"MAP@100":0.1}'
    settings = dict(task="nq", generator="g", retriever="bm25", template="nq", method="syn", num_beams=10, max_length=128, chunk_corpus=False)
    root = str(tmp_path / "runs")
    store.write_experiment(report, root, **settings)
    store.write_experiment(report.limit(2), root, **{**settings, "method": "q_syn"})
    store.write_experiment(report.limit(3), root, **{**settings, "method": "q_syn"})
    assert store.read_experiment(spark, root, method="syn").count() == 12
    assert store.read_experiment(spark, root, method="q_syn", task="nq").count() == 3
    with pytest.raises(ValueError):
        store.with_layout(report, task="nq")
