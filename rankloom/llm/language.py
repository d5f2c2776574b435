"""Language identification by unigrams of pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, by the forward algorithm; a
text's is the product over its words. The probabilities are estimated by
expectation-maximisation over the same sums, from all words of at most ``DOCS_PER_LANG``
documents of each language (chosen by the hash of their id), and of at most ``MAX_LANGS``
times as many in all: the bound of labelled rows. The words stay in Spark: a
round's tasks return sums per language and piece, in whole steps of 2^-24, so they do not
depend on how the words are dealt. Every text is then scored whole, in one pass without a
shuffle; the tasks are given one probability per piece and language.

Defined results: words are runs of letters with their marks, in lower case; a null text or one without a
letter is ``und`` with score 0, as is everything when no document is labelled; equal
texts have equal results, and repeated rows of one id and language are learned from as one
id; a null ``doc_id`` is not learned from; ties go to the first language by name; an empty
table gives no rows; texts of any length are read whole; extra columns are not read.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import CACHE_ENTRIES, slices, texts
from rankloom.operators.ordering import top_k
from rankloom.session import cut_lineage

FOLDS, HELD_FOLD = 4, 2
DOCS_PER_LANG = 400
MAX_LANGS = 400
ROUNDS = 3
# Bytes of a worker's table of words.
SCORER_BYTES = 64 * 1024 * 1024
SMOOTHING = 0.05
START = "▁"
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_RESCALE = 12
# Expected counts are summed as whole numbers of this part.
_STEP = 2.0**-24


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Pieces:
    """The vocabulary's pieces; what it does not know is one unknown piece per letter."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.ids = {name: i for i, name in enumerate(dict.fromkeys(names))}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = len(self.ids)  # a letter that is no piece
        self.none = self.unknown + 1  # a string that is no piece: probability 0
        self.size = self.none + 1

    def table(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: the piece of each span ``(i, j)`` in each word."""
        n, find, none = len(words[0]), self.ids.get, self.none
        spans = {}
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                ids = np.fromiter((find(w[i:j], none) for w in words), np.int32, len(words))
                if j - i == 1:
                    ids[ids == none] = self.unknown
                elif not (ids != none).any():
                    continue
                spans[i, j] = ids
        return spans


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(spans: dict, n: int, chances: np.ndarray, count: int, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Scaled forward sums per position, and the log probability per word and language."""
    sums = [np.ones((count, chances.shape[1]))]
    logs = np.zeros((count, chances.shape[1]))
    for j in range(1, n + 1):
        total = np.zeros_like(logs)
        for i in range(max(0, j - longest), j):
            ids = spans.get((i, j))
            if ids is not None:
                total += sums[i] * chances[ids]
        sums.append(total)
        if j % _RESCALE == 0 or j == n:
            logs += np.log(total)
            scale = 1 / total
            for i in range(max(0, j - longest), j + 1):
                sums[i] = sums[i] * scale
    return sums, logs


def by_length(words: list[str], most: int = 20_000, letters: int = 600_000) -> Iterator[list[int]]:
    """Places of words of equal length, in blocks of at most so many words and letters (or of one word)."""
    groups = defaultdict(list)
    for at, word in enumerate(words):
        groups[len(word)].append(at)
    for length, places in groups.items():
        step = max(1, min(most, letters // max(1, length)))
        for start in range(0, len(places), step):
            yield places[start : start + step]


def log_chances(words: list[str], made: Pieces, chances: np.ndarray) -> np.ndarray:
    out = np.empty((len(words), chances.shape[1]))
    marked = [START + word for word in words]
    for places in by_length(marked):
        group = [marked[i] for i in places]
        out[places] = forward(made.table(group), len(group[0]), chances, len(group), made.longest)[1]
    return out


def expected(words: list[str], langs: np.ndarray, weights: np.ndarray, made: Pieces, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of pieces over all segmentations of words, each of its own language and weight.

    Returns ``piece * languages + language`` and the counts in steps of ``_STEP``, one row
    per block that has them.
    """
    count = chances.shape[1]
    marked = [START + word for word in words]
    keys, totals = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for places in by_length(marked):
        spans, n, lang = made.table([marked[i] for i in places]), len(marked[places[0]]), langs[places]
        # Sums are kept as fractions and powers of two, so long words neither vanish nor round.
        ahead, up = [np.ones(len(places))], [np.zeros(len(places), np.int32)]
        for j in range(1, n + 1):
            near = ((i, ids) for i in range(max(0, j - made.longest), j) if (ids := spans.get((i, j))) is not None)
            part, power = np.frexp(sum(np.ldexp(ahead[i] * chances[ids, lang], up[i] - up[j - 1]) for i, ids in near))
            ahead.append(part)
            up.append(up[j - 1] + power)
        behind, down = [None] * n + [np.ones(len(places))], [None] * n + [np.zeros(len(places), np.int32)]
        for i in range(n - 1, -1, -1):
            near = ((j, ids) for j in range(i + 1, min(n, i + made.longest) + 1) if (ids := spans.get((i, j))) is not None)
            behind[i], power = np.frexp(sum(np.ldexp(behind[j] * chances[ids, lang], down[j] - down[i + 1]) for j, ids in near))
            down[i] = down[i + 1] + power
        share = weights[places] / ahead[n]
        met, parts = [], []
        for (i, j), ids in spans.items():
            at = np.flatnonzero(ids != made.none)
            met.append(ids[at].astype(np.int64) * count + lang[at])
            part = np.ldexp(ahead[i] * chances[ids, lang] * behind[j] * share, up[i] + down[j] - up[n])
            parts.append(np.rint(part[at] / _STEP))
        key, at = np.unique(np.concatenate(met), return_inverse=True)
        keys.append(key)
        totals.append(np.bincount(at, np.concatenate(parts)).astype(np.int64))
    return np.concatenate(keys), np.concatenate(totals)


def estimate(counted: DataFrame, langs: list[str], path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities per language from word counts ``(lang, word, n)``."""
    made, at = pieces(path), {lang: i for i, lang in enumerate(langs)}
    chances = np.full((made.size, len(langs)), 1.0 / made.size)
    chances[made.none] = 0
    for _ in range(rounds):
        shared = counted.sparkSession.sparkContext.broadcast(chances)

        def run(batches):
            for batch in slices(batches, "word"):
                numbers = np.fromiter(map(at.__getitem__, batch.column("lang").to_pylist()), np.int64, batch.num_rows)
                weights = batch.column("n").to_numpy().astype(np.float64)
                found = expected(batch.column("word").to_pylist(), numbers, weights, pieces(path), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in found], ["key", "total"])

        # One row per piece and language reaches the driver.
        sums = counted.mapInArrow(run, "key bigint, total bigint").groupBy("key").agg(F.sum("total").alias("total")).toArrow()
        chances = np.full(chances.size, SMOOTHING)
        chances[sums.column("key").to_numpy()] += sums.column("total").to_numpy() * _STEP
        chances = chances.reshape(made.size, len(langs))
        chances[made.none] = 0
        chances /= chances.sum(axis=0)
        shared.unpersist()
    return chances


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def fit(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities."""
    usable = docs.select("doc_id", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    order = [F.asc(F.xxhash64("doc_id")), F.asc("doc_id")]
    chosen = top_k(usable, "lang", order, DOCS_PER_LANG, rank="_place", spread="doc_id").orderBy("_place", "lang")
    # At most MAX_LANGS * DOCS_PER_LANG ids are broadcast.
    chosen = chosen.limit(MAX_LANGS * DOCS_PER_LANG).select("doc_id", "lang")

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist()):
                rows.extend((lang, word, n) for word, n in Counter(words_of(text)).items())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, [pa.string(), pa.string(), pa.int64()])], ["lang", "word", "n"])

    words = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").mapInArrow(run, "lang string, word string, n bigint")
    # Dealt evenly, as a word costs far more time than bytes.
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    counted = cut_lineage(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(tasks, "lang", "word"))
    langs = sorted(row["lang"] for row in counted.select("lang").distinct().collect())
    return langs, estimate(counted, langs, path) if langs else np.zeros((0, 0))


class Scorer:
    """Log probabilities of words, each computed once while it is in the cache."""

    def __init__(self, path: str, chances: np.ndarray):
        self.pieces, self.chances = pieces(path), chances
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, self.chances.shape[1]))

    def totals(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability per text and language, and the number of words per text."""
        split = [words_of(text) for text in rows]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > min(CACHE_ENTRIES, SCORER_BYTES // (8 * self.chances.shape[1])):
            self._empty()
            new = list(set().union(*split))
        if new:
            first, last = len(self.known), len(self.known) + len(new)
            if last > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((max(last, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))))
            self.rows[first:last] = log_chances(new, self.pieces, self.chances)
            self.known.update(zip(new, range(first, last)))
        find = self.known.__getitem__
        out = np.zeros((len(rows), self.chances.shape[1]))
        for at, words in enumerate(split):
            if words:
                out[at] = self.rows[np.fromiter(map(find, words), np.int32, len(words))].sum(axis=0)
        return out, np.array([len(words) for words in split])


_SCORERS: dict[str, Scorer] = {}


def languages(docs: DataFrame, path: str, langs: list[str], chances: np.ndarray) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``; score is the posterior of equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(chances)
    number = uuid.uuid4().hex

    def run(batches):
        if langs and number not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[number] = Scorer(path, shared.value)
        for batch in slices(batches):
            if langs:
                logs, sizes = _SCORERS[number].totals(texts(batch))
                best = logs.argmax(axis=1)
                score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                sizes = best = score = np.zeros(batch.num_rows, np.int64)
            pred = pa.array([langs[b] if n else "und" for b, n in zip(best.tolist(), sizes.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pred, pa.array(np.where(sizes > 0, score, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
