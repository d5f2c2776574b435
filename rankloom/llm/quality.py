"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are hashed indicators: lower-cased words, and pairs and triples of word shapes
(``ERWHED!!`` is ``A!!``) that also tell whether neighbouring words are the same. Each
indicator is scaled by the log of the ratio of its smoothed frequencies in the two
classes; on the scaled indicators a linear hinge-loss model is fitted by dual coordinate
descent; a logistic curve fitted on rows left out of that fit turns margins into scores.

The model is fitted on at most ``MAX_ROWS`` labelled rows, chosen by the hash of their id.
Every text is then scored whole, in one pass without a shuffle; what the tasks are given
is one weight per hash place, of fixed size.

Defined results: a null or empty text has no indicators and gets the score of the bias;
labels other than 0 and 1, and labels of unknown documents, are ignored; a document
labelled twice counts with its greatest label; with labels of one class only (or none) the
score is that class (or 0.5); a null ``doc_id`` is scored and not held out; ids are whole
numbers; of texts that repeat an id the least is learned from, and each row is scored; equal
texts have equal scores; an empty table gives no rows; texts of any length are read whole;
extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import HASH_ENTRIES, kept_in_worker, slices, texts
from rankloom.llm.minhash import mix

PLACES = 1 << 18
MAX_ROWS = 12_000
FOLDS = 5
THRESHOLD = 0.3
EPOCHS = 12
# Cost of a margin violation, and the share of rows the logistic curve is fitted on.
COST = 0.02
CURVE_SHARE = 4

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    return _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))


class Indicators:
    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        """Distinct hash places of the text's n-grams."""
        words, known = text.split(), self.known
        if not words:
            return np.empty(0, np.int32)
        new = set(words).difference(known)
        if len(known) + len(new) > HASH_ENTRIES:
            known.clear()
            new = set(words)
        for word in new:
            own = xxhash.xxh32_intdigest(word.lower().encode())
            known[word] = own | xxhash.xxh32_intdigest(shape(word).encode()) << 32
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        own, shapes = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)
        same = (own[1:] == own[:-1]).astype(np.uint64) << np.uint64(40)
        pairs = mix(mix(shapes[:-1]) ^ shapes[1:] ^ same)
        triples = mix(mix(pairs[:-1] ^ np.uint64(1)) ^ pairs[1:])
        places = np.concatenate((mix(own ^ np.uint64(1 << 33)), pairs, triples)) % np.uint64(PLACES)
        return np.unique(places.astype(np.int32))


def indicators() -> Indicators:
    return kept_in_worker(("indicators",), Indicators)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> list[tuple[int, np.ndarray]]:
    """Label and indicators of at most ``max_rows`` documents that are not held out, in a fixed order."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = indicators()
        for batch in slices(batches):
            places = pa.array([made.of(text) for text in texts(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), places], ["doc_id", "quality", "places"])

    # At most max_rows ids are broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    rows = found.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, places array<int>").toArrow()
    ids = rows.column("doc_id").to_numpy()
    order = np.lexsort((ids, mix(ids.astype(np.uint64))))
    places, quality = rows.column("places").combine_chunks(), rows.column("quality").to_numpy()
    edges, flat = places.offsets.to_numpy(), places.values.to_numpy()
    return [(int(quality[i]), flat[edges[i] : edges[i + 1]]) for i in order.tolist()]


def log_count_ratios(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    counts = np.ones((2, PLACES))
    for label, places in rows:
        counts[label][places] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[tuple[int, np.ndarray]], scale: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * hinge losses; violations of the rarer class cost more."""
    target = np.array([1.0 if label else -1.0 for label, _ in rows])
    share = max((target > 0).mean(), 1e-9)
    bounds = np.where(target > 0, cost / (2 * share), cost / (2 * max(1 - share, 1e-9)))
    weights, bias, alphas = np.zeros(PLACES), 0.0, np.zeros(len(rows))
    squares = scale * scale
    norms = np.array([float(squares[places].sum()) + 1.0 for _, places in rows])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            places = rows[i][1]
            x = scale[places]
            slope = target[i] * (float(weights[places] @ x) + bias) - 1.0
            alpha = min(max(alphas[i] - slope / norms[i], 0.0), bounds[i])
            step = (alpha - alphas[i]) * target[i]
            if step:
                alphas[i] = alpha
                weights[places] += step * x
                bias += step
    return weights * scale, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margin to probability, by Newton steps with smoothed targets."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = max(margins.std(), 1e-9)
    x = np.stack((margins / spread, np.ones(len(margins))), axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curvature, x.T @ (target - p) - 1e-3 * beta), -2, 2)
    return float(max(beta[0], 0.0) / spread), float(beta[1])


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, offset: float, constant: float | None = None):
        self.weights, self.bias, self.slope, self.offset, self.constant = weights, bias, slope, offset, constant

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum()) + self.bias

    def score(self, places: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    rows = labelled_sample(docs, labels, max_rows)
    classes = {label for label, _ in rows}
    if len(classes) < 2:
        return Model(None, 0.0, 0.0, 0.0, float(classes.pop()) if classes else 0.5)
    curve = rows[::CURVE_SHARE]
    inner = [row for i, row in enumerate(rows) if i % CURVE_SHARE]
    if len({label for label, _ in inner}) < 2 or len({label for label, _ in curve}) < 2:
        curve = inner = rows
    weights, bias = dual_coordinate_descent(inner, log_count_ratios(inner), COST, EPOCHS)
    model = Model(weights, bias, 1.0, 0.0)
    margins = np.array([model.margin(places) for _, places in curve])
    model.slope, model.offset = logistic_curve(margins, np.array([label for label, _ in curve]))
    return model


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        made, given = indicators(), shared.value
        for batch in slices(batches):
            scores = pa.array([given.score(made.of(text)) for text in texts(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        made, given = indicators(), shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([given.score(made.of(text)) >= threshold for text in texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
