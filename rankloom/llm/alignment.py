"""Cross-tokenizer alignment by interval coalescing.

The tokens of two vocabularies, A and B, cover the same bytes of a text. All of them are
sorted by where they begin; where a token begins at or behind the running maximum of the
ends before it, a new group begins, so groups are cut where tokens of both sides end.
Inside a group every A token is linked with the B tokens that share bytes with it.

Three steps: tokenise and align, and store each document's distinct id pairs with how often
they occur in it; count over all documents how many hold a pair; look the counts up again
for each document. The counts are broadcast in waves of bounded size, each over the stored
pairs, and the sums of the waves are added.

Defined results: a text that is null or empty, or that one of the vocabularies does not
give back byte for byte (with a blank in front), has no tokens: zeros and an empty digest;
repeated rows are documents of their own; a null ``doc_id`` is carried as it is; an empty
table gives no rows; pairs that tie for the highest count of an A id are all best; texts of
any length are read whole; extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.bpe import PIECES, byte_symbols
from rankloom.llm.common import slices
from rankloom.session import cut_lineage

# Bytes of text that are tokenised at once, and of stored pairs that are read at once.
TEXT_BYTES, PAIR_BYTES = 1 << 20, 1 << 22
# Pair counts that a task holds, and that tasks are given at once.
HELD_PAIRS, WAVE_PAIRS = 4_000_000, 4_000_000
BLANK = "▁"
_RUN = 10_000
_LONG_RUN = re.compile(r"\s{%d}" % _RUN)


class ByteLevel:
    """A: a byte-level vocabulary. Special tokens' strings inside texts are plain text.

    Two libraries run the same vocabulary file with equal ids. The faster one cannot take
    very long runs of blanks; texts with such a run go to the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        back = {symbol: byte for byte, symbol in byte_symbols().items()}
        with open(path, encoding="utf-8") as file:
            special = {token["content"] for token in json.load(file)["added_tokens"]}
        self.bytes_of, ranks = [b""] * self.tokenizer.get_vocab_size(), {}
        for token, at in self.tokenizer.get_vocab().items():
            self.bytes_of[at] = token.encode() if token in special else bytes(back[c] for c in token)
            if token not in special:
                ranks[self.bytes_of[at]] = at
        self.fast = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, rows: list[str]) -> list[list[int]]:
        return [self._slow(text) if len(text) > _RUN and _LONG_RUN.search(text) else self.fast(" " + text) for text in rows]

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """B: a piece vocabulary with byte fallback, which puts a blank in front by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for at in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(at)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(at) else piece.replace(BLANK, " ").encode())

    def encode(self, rows: list[str]) -> list[list[int]]:
        return self.model.encode(rows, num_threads=1)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.lengths = [np.array([len(x) for x in side.bytes_of], np.int64) for side in (self.a, self.b)]
        ids = [str(at) for side in (self.a, self.b) for at in range(len(side.bytes_of))]
        # Each id as it is written inside a group, before the other side, and at a group's end.
        self.written = [at + mark for mark in ",|;" for at in ids]
        self.n_a, self.n_b = len(self.a.bytes_of), len(self.b.bytes_of)

    def tokens(self, rows: list[str]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """Which rows both sides give back byte for byte, and their ids."""
        there = [at for at, text in enumerate(rows) if text]
        texts = [rows[at] for at in there]
        if not texts:
            return [], [], []
        good, ids_a, ids_b = [], [], []
        for at, text, a, b in zip(there, texts, self.a.encode(texts), self.b.encode(texts)):
            whole = b" " + text.encode()
            if b"".join(map(self.a.bytes_of.__getitem__, a)) == whole and b"".join(map(self.b.bytes_of.__getitem__, b)) == whole:
                good.append(at)
                ids_a.append(a)
                ids_b.append(b)
        return good, ids_a, ids_b

    def align(self, ids_a: list[list[int]], ids_b: list[list[int]]):
        """Counts, digests and pairs of documents; their bytes lie one behind the other.

        ``(n_a, n_b, n_groups, n_links, digests, pair_ends, pairs, times)``: the distinct
        pairs ``a * n_b + b`` of all documents in one array, sorted in each, and how often
        each occurs.
        """
        sizes = [np.array([len(row) for row in side], np.int64) for side in (ids_a, ids_b)]
        a, b = (np.concatenate([np.array(row, np.int64) for row in side]) for side in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        start_a, start_b = end_a - self.lengths[0][a], end_b - self.lengths[1][b]

        starts = np.concatenate([start_a, start_b])
        order = np.lexsort((starts,))
        reach = np.maximum.accumulate(np.concatenate([end_a, end_b])[order])
        begins = np.ones(len(order), bool)
        begins[1:] = starts[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1

        ends_a, ends_b = np.cumsum(sizes[0]), np.cumsum(sizes[1])
        last = group[ends_a - 1]
        n_groups = np.diff(last, prepend=-1)

        side = np.zeros(len(order), np.int64)
        side[len(a) :] = 1
        place = 2 * group + side
        in_group = np.argsort(place, kind="stable")
        place = place[in_group]
        closes = np.ones(len(place), bool)
        closes[:-1] = place[1:] != place[:-1]
        mark = np.where(closes, 1 + (place & 1), 0)
        codes = np.concatenate([a, b + self.n_a])[in_group] + mark * (self.n_a + self.n_b)
        parts, digests, at = list(map(self.written.__getitem__, codes.tolist())), [], 0
        for to in (ends_a + ends_b).tolist():
            digests.append(sha256("".join(parts[at:to])[:-1].encode()).hexdigest())
            at = to

        # The B tokens that share bytes with an A token follow each other.
        first = np.searchsorted(end_b, start_a, "right")
        many = np.searchsorted(start_b, end_a, "left") - first
        before = np.cumsum(many) - many
        of_a = np.repeat(np.arange(len(a)), many)
        of_b = np.arange(len(of_a)) - np.repeat(before - first, many)
        n_links = np.diff(np.cumsum(many)[ends_a - 1], prepend=0)

        span = np.uint64(self.n_a * self.n_b)
        document = np.repeat(np.arange(len(ids_a), dtype=np.uint64), n_links)
        links = np.sort(document * span + (a[of_a] * self.n_b + b[of_b]).astype(np.uint64))
        new = np.ones(len(links), bool)
        new[1:] = links[1:] != links[:-1]
        at = np.flatnonzero(new)
        times = np.diff(at, append=len(links))
        pair_ends = np.searchsorted(links[at], (np.arange(len(ids_a), dtype=np.uint64) + np.uint64(1)) * span)
        return sizes[0], sizes[1], n_groups, n_links, digests, pair_ends, (links[at] % span).astype(np.int64), times


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def pair_type(n_a: int, n_b: int) -> str:
    return "<u4" if n_a * n_b < 1 << 32 else "<u8"


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    return pa.compress(numbers.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


_OWN = ["n_a", "n_b", "n_groups", "n_links"]
_STORED = "part int, row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_pairs bigint, pairs binary, times binary"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: its counts, the digest of its groups, and its distinct pairs, packed.

    ``part`` and ``row`` name the document, once the table is written.
    """

    def run(batches):
        both, part, seen = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        kind = pair_type(both.n_a, both.n_b)
        for batch in slices(batches, size=TEXT_BYTES):
            n = batch.num_rows
            good, ids_a, ids_b = both.tokens(batch.column("text").to_pylist())
            numbers, digests, pairs, times, n_pairs = np.zeros((4, n), np.int64), [""] * n, [b""] * n, [b""] * n, np.zeros(n, np.int64)
            if good:
                *own, shas, ends, keys, counts = both.align(ids_a, ids_b)
                numbers[:, good] = own
                begin = 0
                for at, sha, end in zip(good, shas, ends.tolist()):
                    digests[at], n_pairs[at] = sha, end - begin
                    pairs[at] = _packed(np.diff(keys[begin:end], prepend=0), kind)
                    times[at] = _packed(counts[begin:end], "<u4")
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), batch.column("doc_id"), *map(pa.array, numbers),
                    pa.array(digests, pa.string()), pa.array(n_pairs), pa.array(pairs, pa.binary()), pa.array(times, pa.binary()),
                ],
                ["part", "row", "doc_id", *_OWN, "groups_sha256", "n_pairs", "pairs", "times"],
            )
            seen += n

    return docs.select("doc_id", "text").mapInArrow(run, _STORED.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def _pairs_of(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a batch's documents in one array, and how many each has."""
    sizes = batch.column("n_pairs").to_numpy()
    rows = [np.cumsum(_unpacked(data, kind, n).astype(np.int64)) for data, n in zip(batch.column("pairs").to_pylist(), sizes.tolist()) if n]
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), sizes


def pair_counts(stored: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """``(pair, n, best)``: documents that hold a pair, and whether no other pair of its A id is held by more."""
    kind = pair_type(n_a, n_b)

    def run(batches):
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            every = np.concatenate([keys, *waiting])
            found, where = np.unique(every, return_inverse=True)
            numbers = np.bincount(where[len(keys) :], minlength=len(found)).astype(np.int64)
            numbers[where[: len(keys)]] += counts
            return found, numbers

        for batch in slices(batches, "pairs", size=PAIR_BYTES):
            waiting.append(_pairs_of(batch, kind)[0])
            size += len(waiting[-1])
            if size > HELD_PAIRS:
                keys, counts = merged()
                waiting, size = [], 0
                if len(keys) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = merged()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    partial = stored.select("n_pairs", "pairs").mapInArrow(run, "pair bigint, n bigint")
    sums = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = W.partitionBy("a")
    # An A id has as many pairs as B has ids, at most.
    return sums.withColumn("a", F.expr(f"pair div {n_b}")).select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def _looked_up(stored: DataFrame, shared, wave: int, waves: int, kind: str) -> DataFrame:
    names = ["part", "row", "n_best", "count_sum"]

    def run(batches):
        known, numbers, best = shared.value
        for batch in slices(batches, "pairs", size=PAIR_BYTES):
            pairs, sizes = _pairs_of(batch, kind)
            columns = zip(batch.column("times").to_pylist(), sizes.tolist())
            times = [_unpacked(data, "<u4", n).astype(np.int64) for data, n in columns if n]
            sums = np.zeros((2, len(pairs) + 1), np.int64)
            if len(pairs):
                mine = np.flatnonzero(pairs % waves == wave)
                at = np.searchsorted(known, pairs[mine].astype(known.dtype))
                often = np.concatenate(times)[mine]
                sums[0, mine + 1], sums[1, mine + 1] = often * best[at], often * numbers[at]
                np.cumsum(sums, axis=1, out=sums)
            ends = np.cumsum(sizes)
            of_doc = sums[:, ends] - sums[:, ends - sizes]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), pa.array(of_doc[0]), pa.array(of_doc[1])], names)

    return stored.select("part", "row", "n_pairs", "pairs", "times").mapInArrow(run, "part int, row bigint, n_best bigint, count_sum bigint")


def alignment_report(docs: DataFrame, path_a: str, path_b: str, wave_pairs: int = WAVE_PAIRS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``."""
    both = aligner(path_a, path_b)
    kind = pair_type(both.n_a, both.n_b)
    stored = cut_lineage(aligned(docs, path_a, path_b))
    counts = cut_lineage(pair_counts(stored, both.n_a, both.n_b))
    waves = max(1, -(-counts.count() // wave_pairs))
    parts = []
    for wave in range(waves):
        # About wave_pairs rows of 17 bytes: numbers of the vocabularies, not of documents.
        table = counts.filter(F.pmod("pair", F.lit(waves)) == wave).toArrow()
        order = np.argsort(table.column("pair").to_numpy())
        arrays = (table.column("pair").to_numpy()[order].astype(kind), table.column("n").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order])
        parts.append(_looked_up(stored, docs.sparkSession.sparkContext.broadcast(arrays), wave, waves, kind))
    sums = functools.reduce(DataFrame.unionByName, parts).groupBy("part", "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return stored.select("part", "row", "doc_id", *_OWN, "groups_sha256").join(sums, ["part", "row"]).select("doc_id", *_OWN, "n_best", "count_sum", "groups_sha256")


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(doc_id, groups)``: the groups themselves, each with its A ids and its B ids, in order."""

    def run(batches):
        both = aligner(path_a, path_b)
        for batch in slices(batches, size=TEXT_BYTES):
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            good, ids_a, ids_b = both.tokens(batch.column("text").to_pylist())
            for at, a, b in zip(good, ids_a, ids_b):
                ends = [np.cumsum(lengths[ids]) for lengths, ids in zip(both.lengths, (a, b))]
                cuts = np.intersect1d(*ends)
                to = [np.searchsorted(end, cuts, "right").tolist() for end in ends]
                rows[at] = [{"a": a[i:j], "b": b[k:m]} for i, j, k, m in zip([0, *to[0]], to[0], [0, *to[1]], to[1])]
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "groups"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")
