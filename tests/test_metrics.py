import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import evaluation as ev
from rankloom.operators import list_metrics as lm

RUN = "query_id string, corpus_id string, score double"
QRELS = "query_id string, corpus_id string, relevance int, ord long"
LISTS = "predictions array<float>, references array<float>"
LABELS = "predictions array<int>, references array<int>"


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_ties_rank_by_id_descending(spark):
    run = spark.createDataFrame([("q", d, 1.0) for d in ("d1", "d2", "d10")], RUN)
    ranked = ev.rank_run(run).orderBy("rank").collect()
    assert [r["corpus_id"] for r in ranked] == ["d2", "d10", "d1"]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q1", "a", 3.0), ("q1", "b", 2.0), ("q1", "c", 1.0), ("q2", "x", 1.0), ("q9", "a", 1.0)], RUN)
    qrels = spark.createDataFrame(
        [("q1", "a", 1, 1), ("q1", "c", 2, 2), ("q1", "zz", 1, 3), ("q1", "b", 0, 4), ("q2", "y", 1, 1), ("q3", "a", 1, 1)], QRELS
    )
    got = {(r["query_id"], r["metric"], r["k"]): r["value"] for r in ev.per_query_metrics(run, qrels, [1, 3]).collect()}
    dcg = 1 / math.log2(2) + 2 / math.log2(4)
    ideal = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert got["q1", "NDCG", 3] == pytest.approx(dcg / ideal)
    assert got["q1", "NDCG", 1] == pytest.approx(1 / 2)
    assert got["q1", "MAP", 3] == pytest.approx((1 / 1 + 2 / 3) / 3)
    assert got["q1", "Recall", 3] == pytest.approx(2 / 3)
    assert got["q1", "P", 3] == pytest.approx(2 / 3)
    assert got["q2", "NDCG", 3] == 0 and got["q2", "P", 1] == 0
    # q3 has no results and q9 no judgements.
    assert {q for q, _, _ in got} == {"q1", "q2"}
    with_empty = ev.per_query_metrics(run, qrels, [1], include_empty=True)
    assert {r["query_id"] for r in with_empty.collect()} == {"q1", "q2", "q3"}


def test_judged_query_without_positives_scores_zero(spark):
    run = spark.createDataFrame([("q", "a", 1.0)], RUN)
    qrels = spark.createDataFrame([("q", "a", 0, 1)], QRELS)
    assert {r["value"] for r in ev.per_query_metrics(run, qrels, [1, 5]).collect()} == {0.0}


def test_self_matches_are_dropped(spark):
    run = spark.createDataFrame([("a", "a", 9.0), ("a", "b", 1.0)], RUN)
    assert [r["corpus_id"] for r in ev.drop_self_matches(run).collect()] == ["b"]
    qrels = spark.createDataFrame([("a", "b", 1, 1)], QRELS)
    report = {(r["metric"], r["k"]): r["value"] for r in ev.metric_report(run, qrels, [1]).collect()}
    assert report["P", 1] == 1.0


def test_zero_fill_gives_the_metrics_of_the_whole_corpus(spark):
    corpus = spark.createDataFrame([(f"d{i}", "", "") for i in range(40)], "corpus_id string, title string, text string")
    queries = spark.createDataFrame([("q1", ""), ("q2", ""), ("d39", "")], "query_id string, text string")
    run = spark.createDataFrame([("q1", "d3", 0.5), ("q1", "d39", 0.4), ("d39", "d39", 0.9)], RUN)
    qrels = spark.createDataFrame(
        [(q, f"d{i}", 1, i) for q in ("q1", "q2", "d39") for i in (3, 8, 9, 38, 39)], QRELS
    )
    ks = [1, 3, 5, 1000]
    filled = ev.zero_fill(run, qrels, corpus)
    whole = queries.select("query_id").join(corpus.select("corpus_id"), F.lit(True)).join(run, ["query_id", "corpus_id"], "left").fillna(0.0)
    key = lambda r: (r["query_id"], r["metric"], r["k"])
    a = {key(r): r["value"] for r in ev.per_query_metrics(filled, qrels, ks, ranked_run=True).collect()}
    b = {key(r): r["value"] for r in ev.per_query_metrics(whole, qrels, ks).collect()}
    assert a == b and len(a) == 3 * 4 * 4


@pytest.mark.parametrize(
    "predictions, references, k, name, want",
    [
        ([0.1, 0.2, 0.3, 4.0, 70.0], [10.0, 0.0, 0.0, 1.0, 5.0], None, "nDCG", 9.8962),
        ([0.1, 0.2, 0.3, 4.0, 70.0], [10.0, 0.0, 0.0, 1.0, 5.0], 3, "nDCG@3", 0.1765),
        ([1.0, 1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0], 1, "nDCG@1", 1.0),
        ([0.0, 1.0, 0.0], [0.0, 0.0, 0.0], 3, "nDCG@3", 10 / math.log2(3)),
    ],
)
def test_list_ndcg_by_formula(spark, predictions, references, k, name, want):
    rows = spark.createDataFrame([(predictions, references)], LISTS)
    assert values(lm.list_ndcg(rows, k)) == {name: pytest.approx(want, abs=1e-4)}


def test_list_ndcg_fails_on_short_rows(spark):
    rows = spark.createDataFrame([([1.0], [1.0])], LISTS)
    with pytest.raises(Exception, match="fewer predictions than k"):
        lm.list_ndcg(rows, 3).collect()


def test_recall_examples(spark):
    rows = spark.createDataFrame([([0, 1, 0, 1, 1], [0, 0, 1, 1, 1])], LABELS)
    assert values(lm.list_recall(rows)) == {"recall": pytest.approx(2 / 3)}
    assert values(lm.list_recall(rows, pos_label=0)) == {"recall": pytest.approx(0.5)}
    weighted = lm.list_recall(rows, sample_weight=[0.9, 0.2, 0.9, 0.3, 0.8])
    assert values(weighted) == {"recall": pytest.approx(0.55)}
    assert values(lm.list_recall(rows, [1, 3])) == {"recall@1": 0.0, "recall@3": 0.0}
    classes = spark.createDataFrame([([0, 2, 1, 0, 0, 1], [0, 1, 2, 0, 1, 2])], LABELS)
    for average in ("macro", "micro", "weighted"):
        assert values(lm.list_recall_multiclass(classes, average)) == {"recall": pytest.approx(1 / 3)}
    each = values(lm.list_recall_multiclass(classes, None, labels=[0, 1, 2]))
    assert each == {"recall[0]": 1.0, "recall[1]": 0.0, "recall[2]": 0.0}
    assert values(lm.list_recall_multiclass(classes, "macro", labels=[0, 5])) == {"recall": pytest.approx(0.5)}


def test_recall_weights_must_match(spark):
    rows = spark.createDataFrame([([0, 1], [0, 1])], LABELS)
    with pytest.raises(Exception, match="differ in length"):
        lm.list_recall_weighted(rows, [1.0, 1.0], k=1).collect()


def test_query_ndcg(spark):
    flags = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 1)], "query_id string, rank int, hit int")
    judged = spark.createDataFrame([("q", 3)], "query_id string, n_judged long")
    got = lm.query_ndcg(flags, judged, 2).first()["value"]
    assert got == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_ranks_in_buckets_and_blocks(spark, rows, monkeypatch):
    """Ranks over buckets of scores, and filled ranks over blocks of documents, against plain sorting."""
    import random

    dice = random.Random(3)
    docs = [f"d{i}" for i in range(300)] + ["q2"]
    run = [(q, d, float(dice.choice([0, 1, 2, 5, 5.5]))) for q in ("q1", "q2", "q3") for d in dice.sample(docs, 120)]
    judged = [(q, d, 1, 1) for q in ("q1", "q2", "q3", "q4") for d in dice.sample(docs, 90)]
    df = spark.createDataFrame(run, "query_id string, corpus_id string, score double")
    got = {(r["query_id"], r["corpus_id"]): r["rank"] for r in ev.rank_run(df).collect()}
    for q in ("q1", "q2", "q3"):
        own = sorted(((d, s) for x, d, s in run if x == q), key=lambda x: x[0], reverse=True)
        own.sort(key=lambda x: -x[1])
        assert [got[q, d] for d, _ in own] == list(range(1, len(own) + 1))
    monkeypatch.setattr(ev, "BLOCK_DOCS", 17)
    qrels = spark.createDataFrame(judged, "query_id string, corpus_id string, relevance int, ord int")
    corpus = spark.createDataFrame([(d, "", "") for d in docs], "corpus_id string, title string, text string")
    filled = {(r["query_id"], r["corpus_id"]): r["rank"] for r in ev.zero_fill(df, qrels, corpus).collect()}
    want = {}
    for q in ("q1", "q2", "q3", "q4"):
        scores = {d: s for x, d, s in run if x == q}
        order = sorted((d for d in docs if d != q), reverse=True)
        order.sort(key=lambda d: -scores.get(d, 0.0))
        asked = {d for x, d, *_ in judged if x == q}
        want |= {(q, d): at for at, d in enumerate(order, 1) if scores.get(d, 0) > 0 or d in asked}
    assert filled == want


def test_recall_of_label_sets(spark):
    table = [([[1, 0, 1], [0, 1, 0]], [[1, 1, 0], [0, 0, 0]]), ([[1, 1, 1], [0, 0, 1]], [[0, 0, 1], [1, 0, 1]])]
    rows = spark.createDataFrame(table, "predictions array<array<int>>, references array<array<int>>")
    value = lambda **options: {r["metric"]: round(r["value"], 6) for r in lm.list_recall_samples(rows, **options).collect()}
    # Instances: 1/2, none; 1, 1/2.
    assert value() == {"recall": round(((0.5 + 0) / 2 + (1 + 0.5) / 2) / 2, 6)}
    assert value(k=[1]) == {"recall@1": 0.75}
    assert value(zero_division=1.0) == {"recall": round(((0.5 + 1) / 2 + (1 + 0.5) / 2) / 2, 6)}
    assert value(sample_weight=[3.0, 1.0]) == {"recall": round(((1.5 + 0) / 4 + (3 + 0.5) / 4) / 2, 6)}
    assert value(labels=[0]) == {"recall": round(((1 + 0) / 2 + (0 + 0) / 2) / 2, 6)}
