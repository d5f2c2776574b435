"""Secret scan: fixed patterns, and character Markov models for what they miss.

Base spans come from three patterns. The method adds tokens that look random: two
first-order Markov models over the characters of tokens, one of random strings and one of
ordinary identifiers, are compared by the log-likelihood ratio of the whole token.

The models learn from labelled samples: random ones are the values of base matches in at
most ``MAX_DOCS`` documents (chosen by the hash of their id) and a fixed number of strings
drawn at random over usual alphabets; ordinary ones are the other tokens of those
documents. Every text is then scanned whole, in one pass without a shuffle; the tasks are
given one matrix of fixed size.

Defined results: a null text is an empty one, without spans; offsets count code points and
ends are exclusive; an added span never overlaps a base span; base spans of different
kinds may overlap; a null ``doc_id`` is scanned and not learned from; extra columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import kept_in_worker, replaced, slices, texts

# The base patterns and the least lengths of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

KINDS = ["assign", "access", "hex", "random"]
_RANK = {kind: i for i, kind in enumerate(KINDS)}
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

MAX_DOCS = 4_000
# Tokens of at least this many characters are judged.
TOKEN_CHARS = 20
TOKENS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Random strings drawn per alphabet, and what a token's ratio must reach per character and in all.
DRAWN, DRAWN_CHARS = 2_000, 32
LEAST_PER_CHAR, LEAST_TOTAL = 0.5, 20.0
ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
)
_CODES = np.full(128, -1, np.int64)
_CODES[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
_ENDS = len(SYMBOLS)  # the state before the first character and after the last


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    small = text.lower()
    if any(name in small for name in _NAMES):
        for match in ASSIGN.finditer(text):
            if match.end(2) - match.start(2) >= ASSIGN_VALUE:
                found.append(("assign", match.start(), match.end()))
    if "AKIA" in text:
        for match in ACCESS.finditer(text):
            if match.end() - match.start() >= ACCESS_LENGTH:
                found.append(("access", match.start(), match.end()))
    found.extend(("hex", *match.span()) for match in HEX.finditer(text))
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]]))


def _path(token: str) -> np.ndarray:
    codes = _CODES[np.frombuffer(token.encode(), np.uint8)]
    return np.concatenate(([_ENDS], codes, [_ENDS]))


def transitions(tokens: Counter) -> np.ndarray:
    """Counts of neighbouring characters, ends included."""
    counts = np.zeros((_ENDS + 1, _ENDS + 1))
    for token, n in tokens.items():
        path = _path(token)
        np.add.at(counts, (path[:-1], path[1:]), n)
    return counts


def drawn_strings() -> Counter:
    random = np.random.default_rng(0)
    out = Counter()
    for alphabet in ALPHABETS:
        letters = np.array(list(alphabet))
        out.update("".join(row) for row in letters[random.integers(0, len(letters), (DRAWN, DRAWN_CHARS))])
    return out


def ratios(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log of the ratio of the two models' transition probabilities."""

    def chances(counts):
        counts = counts + 0.5
        return counts / counts.sum(axis=1, keepdims=True)

    return np.log(chances(random)) - np.log(chances(ordinary))


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> np.ndarray:
    """The matrix of log-likelihood ratios."""
    chosen = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, ordinary = np.zeros((_ENDS + 1, _ENDS + 1)), np.zeros((_ENDS + 1, _ENDS + 1))
        for batch in slices(batches):
            values, others = Counter(), Counter()
            for text in texts(batch):
                spans, at, rest = base_spans(text), 0, []
                for kind, begin, end in spans:
                    value = ASSIGN.match(text, begin, end).group(2) if kind == "assign" else text[begin:end]
                    values.update(ORDINARY.findall(value))
                    rest.append(text[at:begin])
                    at = max(at, end)
                others.update(ORDINARY.findall(" ".join([*rest, text[at:]])))
            random += transitions(values)
            ordinary += transitions(others)
        yield pa.RecordBatch.from_arrays([pa.array([random.ravel()], pa.list_(pa.float64())), pa.array([ordinary.ravel()], pa.list_(pa.float64()))], ["random", "ordinary"])

    # At most max_docs ids are broadcast; a task returns two matrices.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "random array<double>, ordinary array<double>")
    cells = sample.select(F.posexplode(F.arrays_zip("random", "ordinary")).alias("cell", "n")).groupBy("cell").agg(F.sum("n.random").alias("random"), F.sum("n.ordinary").alias("ordinary"))
    counts = np.zeros((2, (_ENDS + 1) ** 2))
    for row in cells.collect():
        counts[:, row["cell"]] = row["random"], row["ordinary"]
    random, ordinary = counts.reshape(2, _ENDS + 1, _ENDS + 1)
    return ratios(random + transitions(drawn_strings()), ordinary)


def random_spans(text: str, model: np.ndarray, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found, before, reach = [], sorted((s, e) for _, s, e in taken), 0
    at = 0
    for match in TOKENS.finditer(text):
        begin, end = match.span()
        # Both lists go forward together: where the spans that begin before this end reach to.
        while at < len(before) and before[at][0] < end:
            reach, at = max(reach, before[at][1]), at + 1
        if reach > begin:
            continue
        path = _path(match.group())
        total = float(model[path[:-1], path[1:]].sum())
        if total >= LEAST_TOTAL and total >= LEAST_PER_CHAR * (end - begin):
            found.append(("random", begin, end))
    return found


def scan(text: str, model: np.ndarray) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, model, base), key=lambda s: (s[1], _RANK[s[0]]))


def secret_spans(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``(doc_id, spans)``: kind, start and end of each span, by start and then by kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(text, shared.value)] for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind_type)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(docs: DataFrame, model: np.ndarray, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced; ``n_chars``, if there, is counted anew.

    Null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        kept_in_worker(("secrets",), object)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                parts, at = [], 0
                for _, begin, end in scan(text, shared.value) if text else []:
                    if begin >= at:
                        parts.extend((text[at:begin], mark))
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield replaced(batch, "text", out)

    made = docs.mapInArrow(run, docs.schema)
    return made.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def digests(spans: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of the rows of ``secret_spans``."""

    def joined(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    counts = [count(kind) for kind in KINDS[:3]]
    return spans.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
