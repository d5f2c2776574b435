"""Metrics over arrays that are compared as given, one pair of arrays per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: stands in for an ideal of 0.
EMPTY_IDEAL = 0.1

Ks = int | Sequence[int] | None


def _cuts(k: Ks, name: str) -> list[tuple[str, int | None]]:
    if k is None:
        return [(name, None)]
    ks = [k] if isinstance(k, int) else list(k)
    return [(f"{name}@{one}", one) for one in ks]


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _discounted(gains: Column) -> Column:
    """Sum of gain over log2(position + 1)."""
    return _fold(F.transform(gains, lambda g, i: g.cast("double") / F.log2(i + 2)))


def _ones(n: Column) -> Column:
    return F.array_repeat(F.lit(1.0), n.cast("int"))


def _cut(values: Column, k: int | None) -> Column:
    return values if k is None else F.slice(values, 1, k)


def _checked(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def _means(rows: DataFrame, named: list[tuple[str, Column]]) -> DataFrame:
    """``(metric, value)``: the mean of each expression over all rows, in one pass."""
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in named])
    return rows.select(F.explode(entries).alias("m")).groupBy("m.metric").agg(F.avg("m.value").alias("value"))


def list_ndcg(rows: DataFrame, k: Ks = None) -> DataFrame:
    """Discounted sum of ``predictions`` over that of as many ones as ``references`` sum to.

    The order is the one given. A row shorter than ``k`` fails.
    """
    p = F.col("predictions")
    answers = F.floor(_fold(F.transform("references", lambda r: r.cast("double"))))

    def ndcg(cut: int | None) -> Column:
        width = F.size(p) if cut is None else F.lit(cut)
        ideal = _discounted(_ones(F.greatest(F.least(answers, width.cast("bigint")), F.lit(0))))
        value = _discounted(_cut(p, cut)) / F.when(ideal == 0, EMPTY_IDEAL).otherwise(ideal)
        return _checked(value, F.size(p) < width, "fewer predictions than k")

    return _means(rows, [(name, ndcg(cut)) for name, cut in _cuts(k, "nDCG")])


def query_ndcg(flags: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """``(query_id, value)`` from hit flags by rank and the number of judged documents.

    ``flags`` is ``(query_id, rank, hit)``, ``judged`` is ``(query_id, n_judged)``.
    """
    dcg = (
        flags.filter(F.col("rank") <= k)
        .groupBy("query_id")
        .agg(F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"))
    )
    ideal = _discounted(_ones(F.least("n_judged", F.lit(k))))
    return judged.join(dcg, "query_id").select("query_id", (F.col("dcg") / ideal).alias("value"))


def _ratio(top: Column, bottom: Column, zero_division: float) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(float(zero_division)))


def _recall_of(pairs: Column, label: Column, zero_division: float) -> Column:
    """Recall of one label over ``ARRAY<STRUCT<r, p, w>>``."""
    weight = lambda x: F.when(x["r"] == label, x["w"]).otherwise(0.0)
    hit = lambda x: F.when((x["r"] == label) & (x["p"] == label), x["w"]).otherwise(0.0)
    return _ratio(_fold(F.transform(pairs, hit)), _fold(F.transform(pairs, weight)), zero_division)


def _pairs(cut: int | None, sample_weight: Sequence[float] | None = None) -> tuple[Column, Column]:
    """Positions of a row as structs, and whether the row is malformed."""
    r, p = _cut(F.col("references"), cut), _cut(F.col("predictions"), cut)
    bad = F.size(r) != F.size(p)
    if sample_weight is None:
        pairs = F.transform(F.arrays_zip(r.alias("r"), p.alias("p")), lambda x: F.struct(x["r"].alias("r"), x["p"].alias("p"), F.lit(1.0).alias("w")))
    else:
        w = F.array(*[F.lit(float(v)) for v in sample_weight])
        bad = bad | (F.size(r) != len(sample_weight))
        pairs = F.arrays_zip(r.alias("r"), p.alias("p"), w.alias("w"))
    return pairs, bad


def list_recall(
    rows: DataFrame,
    k: Ks = None,
    pos_label: int = 1,
    sample_weight: Sequence[float] | None = None,
    zero_division: float = 0.0,
) -> DataFrame:
    """Mean over rows of the recall of ``pos_label`` in the first ``k`` positions.

    ``sample_weight`` weighs positions; it is not cut to ``k``, so its length must match.
    """

    def recall(cut: int | None) -> Column:
        pairs, bad = _pairs(cut, sample_weight)
        return _checked(_recall_of(pairs, F.lit(pos_label), zero_division), bad, "arrays differ in length")

    return _means(rows, [(name, recall(cut)) for name, cut in _cuts(k, "recall")])


def list_recall_weighted(rows: DataFrame, sample_weight: Sequence[float], k: Ks = None, pos_label: int = 1) -> DataFrame:
    return list_recall(rows, k, pos_label, sample_weight)


def list_recall_multiclass(
    rows: DataFrame,
    average: str | None,
    k: Ks = None,
    labels: Sequence[int] | None = None,
    zero_division: float = 0.0,
    sample_weight: Sequence[float] | None = None,
) -> DataFrame:
    """Mean over rows of a multi-class recall; ``average`` is micro, macro, weighted or None.

    ``sample_weight`` weighs positions, as in ``list_recall``; sets of labels, average
    ``samples``, are ``list_recall_samples``. Without ``labels`` a row's classes are those it holds. ``average=None`` gives one value
    per class, named ``recall@k[label]``, and needs ``labels``: all rows must agree on them.
    """
    if average not in ("micro", "macro", "weighted", None):
        raise ValueError(f"unknown average {average!r}")
    if average is None and labels is None:
        raise ValueError("average=None needs labels")

    def classes(cut: int | None) -> Column:
        if labels is not None:
            return F.array(*[F.lit(int(v)) for v in labels])
        return F.array_union(_cut(F.col("references"), cut), _cut(F.col("predictions"), cut))

    def averaged(cut: int | None) -> Column:
        pairs, bad = _pairs(cut, sample_weight)
        chosen = classes(cut)
        support = _fold(F.transform(pairs, lambda x: F.when(F.array_contains(chosen, x["r"]), x["w"]).otherwise(0.0)))
        right = _fold(
            F.transform(pairs, lambda x: F.when(F.array_contains(chosen, x["r"]) & (x["r"] == x["p"]), x["w"]).otherwise(0.0))
        )
        if average == "macro":
            each = F.transform(chosen, lambda label: _recall_of(pairs, label, zero_division))
            value = _fold(each) / F.size(chosen)
        else:
            # Weighted by support, the class recalls add up to the overall share of hits.
            value = _ratio(right, support, zero_division)
        return _checked(value, bad, "arrays differ in length")

    named = []
    for name, cut in _cuts(k, "recall"):
        if average is None:
            pairs, bad = _pairs(cut, sample_weight)
            for label in labels:
                value = _checked(_recall_of(pairs, F.lit(int(label)), zero_division), bad, "arrays differ in length")
                named.append((f"{name}[{int(label)}]", value))
        else:
            named.append((name, averaged(cut)))
    return _means(rows, named)


def list_recall_samples(
    rows: DataFrame,
    k: Ks = None,
    labels: Sequence[int] | None = None,
    sample_weight: Sequence[float] | None = None,
    zero_division: float = 0.0,
) -> DataFrame:
    """Mean over rows of the multi-label recall with average ``samples``.

    ``predictions`` and ``references`` are ``ARRAY<ARRAY<INT>>``: an indicator array of 0 and
    1, by label, for each instance. An instance's recall is the share of its reference labels
    that are predicted; a row's is the (weighted) mean over its first ``k`` instances.
    ``labels`` takes these places of the indicators only.
    """

    def recall(cut: int | None) -> Column:
        pairs, bad = _pairs(cut, sample_weight)

        def of_instance(x: Column) -> Column:
            both = F.arrays_zip(x["r"].alias("r"), x["p"].alias("p"))
            if labels is not None:
                both = F.filter(both, lambda _, i: F.array_contains(F.array(*[F.lit(int(v)) for v in labels]), i))
            right = _fold(F.transform(both, lambda y: F.when((y["r"] == 1) & (y["p"] == 1), 1.0).otherwise(0.0)))
            return x["w"] * _ratio(right, _fold(F.transform(both, lambda y: F.when(y["r"] == 1, 1.0).otherwise(0.0))), zero_division)

        uneven = F.exists(pairs, lambda x: F.size(x["r"]) != F.size(x["p"]))
        value = _ratio(_fold(F.transform(pairs, of_instance)), _fold(F.transform(pairs, lambda x: x["w"])), zero_division)
        return _checked(value, bad | uneven, "arrays differ in length")

    return _means(rows, [(name, recall(cut)) for name, cut in _cuts(k, "recall")])
