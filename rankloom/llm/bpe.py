"""Byte-level BPE, encoding and decoding, with a segment tree over pair ranks.

A text is cut into pieces by the vocabulary's fixed pattern. Inside a piece the adjacent
pairs' ranks are the leaves of a segment tree of wide nodes; its root names the leftmost pair of
lowest rank, and a merge changes three leaves. A piece of n bytes costs O(n log n), however long
it is. Pieces seen before come from a bounded cache.

Defined results: a null text is an empty one; an empty text has no ids and decodes to an
empty text; equal rows have equal results; extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankloom.llm.common import CACHE_ENTRIES, slices, texts

# Fixed value: how the byte-level vocabulary cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 60
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class PairTree:
    """A minimum over leaves with the leftmost leaf that holds it.

    A node stands for ``WIDE`` of the level below, so the leaves of a usual piece are one node.
    """

    WIDE = 32

    def __init__(self, ranks: list[int]):
        wide = self.WIDE
        self.levels = levels = [ranks]
        while len(levels[-1]) > wide:
            below = levels[-1]
            levels.append([min(below[at : at + wide]) for at in range(0, len(below), wide)])
        self.top = levels[-1]

    def lowest(self) -> int:
        return min(self.top)

    def leftmost(self, low: int | None = None) -> int:
        """The first leaf that holds the minimum, which may be given."""
        low, wide = min(self.top) if low is None else low, self.WIDE
        at = self.top.index(low)
        for level in self.levels[-2::-1]:
            at = level.index(low, at * wide, at * wide + wide)
        return at

    def put(self, leaf: int, rank: int) -> None:
        below, wide, at = self.levels[0], self.WIDE, leaf
        below[at] = rank
        for level in self.levels[1:]:
            at //= wide
            low = min(below[at * wide : at * wide + wide])
            if level[at] == low:
                return
            level[at] = low
            below = level


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        ids = whole["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = [ids[symbols[b]] for b in range(256)]
        # A pair's rank and, below it, the id that the pair becomes: one number that orders as the rank.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]):
            self.merges[ids[left], ids[right]] = rank << ID_BITS | ids[left + right]
        self.added = {token["content"]: token["id"] for token in whole["added_tokens"]}
        back = {symbol: b for b, symbol in symbols.items()}
        self.bytes_of = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, at in ids.items():
            self.bytes_of[at] = bytes(back[c] for c in token)
        for token, at in self.added.items():
            self.bytes_of[at] = token.encode()
        self.pieces = regex.compile(PIECES).findall
        self.around_added = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def merge(self, piece: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        ids = list(map(self.of_byte.__getitem__, piece.encode()))
        n, merged = len(ids), self.merges.get
        if n == 1:
            return ids[0].to_bytes(4, "little")
        leaves = list(map(merged, zip(ids, ids[1:]), itertools.repeat(NONE)))
        tree = PairTree(leaves)
        # A tree of one node is its leaves: found and written without a call.
        leftmost, put, top = (leaves.index, leaves.__setitem__, leaves) if tree.top is leaves else (tree.leftmost, tree.put, tree.top)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := min(top)) != NONE:
            at = leftmost(low)
            gone = after[at]
            ids[at] = new = low & ID_MASK
            ids[gone] = -1
            after[at] = follow = after[gone]
            if follow < n:
                before[follow] = at
                put(gone, NONE)
                put(at, merged((new, ids[follow]), NONE))
            else:
                put(at, NONE)
            ahead = before[at]
            if ahead >= 0:
                put(ahead, merged((ids[ahead], new), NONE))
        left = [i for i in ids if i >= 0]
        return struct.pack(f"<{len(left)}I", *left)

    def encode(self, text: str) -> np.ndarray:
        if self.around_added is not None and any(token in text for token in self.added):
            parts = self.around_added.split(text)
            ids = b"".join(self.added[p].to_bytes(4, "little") if p in self.added else self._plain(p) for p in parts)
        else:
            ids = self._plain(text)
        return np.frombuffer(ids, "<u4")

    def _plain(self, text: str) -> bytes:
        pieces, known = self.pieces(text), self.known
        found = list(map(known.get, pieces))
        if all(found):
            return b"".join(found)
        new = {piece for piece, ids in zip(pieces, found) if ids is None}
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = set(pieces)
        for piece in new:
            known[piece] = self.merge(piece)
        out = b"".join(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > 64:  # long pieces are not worth a place in the cache
                del known[piece]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker; the file is part of every machine's installation."""
    return Vocabulary(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    vocab = vocabulary(path)
    for batch in slices(batches):
        yield batch, [vocab.encode(text) for text in texts(batch)]


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, ids)``."""

    def run(batches):
        for batch, ids in encode_batches(batches, path):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([row.astype(np.int32) for row in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` to ``(doc_id, text)``; bytes that are no UTF-8 become U+FFFD.

    A null array is an empty one; ids that are null or not in the vocabulary decode to nothing.
    """

    def run(batches):
        vocab = vocabulary(path)
        for batch in slices(batches, "ids"):
            rows = ([i for i in ids or [] if i is not None and 0 <= i < len(vocab.bytes_of)] for ids in batch.column("ids").to_pylist())
            decoded = [vocab.decode(ids) for ids in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the ids and of the text they decode to, in one pass."""
    from hashlib import sha256

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        vocab = vocabulary(path)
        for batch, ids in encode_batches(batches, path):
            counts = pa.array([len(row) for row in ids], pa.int64())
            of_ids = pa.array([sha256(row.tobytes()).hexdigest() for row in ids], pa.string())
            of_text = pa.array([sha256(vocab.decode(row.tolist()).encode()).hexdigest() for row in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, of_ids, of_text], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
