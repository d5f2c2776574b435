"""Concatenate and cut: documents into sequences of a fixed number of tokens.

Pass one tokenises, stores the ids and numbers each partition's tokens from 0. The
partitions' totals, one row each, give every partition its place in one long row of
tokens (a prefix sum over partitions); pass two cuts that row into windows of the fixed
length and records, for each piece, which ids of which document lie where. Only the last
window can be shorter than the others, so that is all the padding there is.

Defined results: a null text is an empty one; every document ends with the end id, so an
empty text is one token long; repeated rows are packed as often as they occur; a null
``doc_id`` is carried as it is; an empty table gives no rows; texts of any length are read
whole; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.bpe import byte_symbols
from rankloom.llm.common import kept_in_worker, slices, texts
from rankloom.session import cut_lineage

WINDOW = 2048
END_ID = 1
_END = END_ID.to_bytes(4, "little")
# Blanks that no token of the vocabulary contains and no rule of it looks across.
_BLANKS = re.compile(r"[ \n\t\r]+")
# Marks that end words, and the last letter whose lower case and composed form are plain.
_MARKS = ".,;:!?|"
_LAST_PLAIN = "\u012f"
# Words of one generation of a worker's cache (about 200 bytes each).
_CACHE = 100_000
# What a text must not hold to be encoded as a whole: an apostrophe, or a sign whose lower case,
# composed form or kind is not plain.
_NOT_PLAIN = re.compile("[^\t\n\r -&(-~À-ÖØ-öø-į¡«»¿]")
_NO_WORD = re.compile("[^a-zß-öø-į\t\n\r ]+")
_SAME_KIND, _DIGIT = re.compile("[0-9]|[^0-9]+"), re.compile("[0-9]")
# str.split() takes these for blanks, the vocabulary does not.
_ODD = re.compile("[\x1c-\x1f]")


def _closed(match: re.Match) -> str:
    """A run of marks and digits with the sign that ends a piece around it and behind its digits."""
    run = match.group()
    return "\0" + (_SAME_KIND.sub("\\g<0>\0", run) if _DIGIT.search(run) else run + "\0")


class Words:
    """Ids of a text: of a plain one as a whole, of others by the parts between blanks.

    In a plain text all pieces of the vocabulary's pattern are runs of small letters, runs of
    marks, or digits, so it is enough to write a piece's end behind each. Other texts' parts
    are tokenised once each and kept in a cache. It has two generations: when the newer is full it becomes the older, and of that only what
    is used again goes over.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.piece = _piece_encoder(path)

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit bytes, the end id last."""
        odd = [at for at, text in enumerate(rows) if "<|" in text or _NOT_PLAIN.search(text)]
        others = dict(zip(odd, self._by_parts([rows[at] for at in odd]) if odd else ()))
        return [others[at] if at in others else self._whole(text) for at, text in enumerate(rows)]

    def _whole(self, text: str) -> bytes:
        closed = _NO_WORD.sub(_closed, text.lower())
        for blank in " \n\t\r":
            closed = closed.replace(blank, "\0")
        return self.piece(closed) + _END

    def _by_parts(self, rows: list[str]) -> list[bytes]:
        split = [_BLANKS.split(text) if _ODD.search(text) else text.split() for text in rows]
        every = set().union(*split)
        new = every.difference(self.known)
        if len(self.known) + len(new) > _CACHE:
            self.older, self.known, new = self.known, {}, every
        known, older = self.known, self.older
        known.update((word, older[word]) for word in new.intersection(older))
        self._learn(new.difference(older))
        out = [b"".join(map(known.__getitem__, parts)) + _END for parts in split]
        for word in new:
            if len(word) > 64:  # long parts are not worth a place in the cache
                del known[word]
        return out

    def _learn(self, new: set[str]) -> None:
        """A word of plain letters and the marks behind it are separate pieces of the
        vocabulary's pattern, and it knows no capitals: such words are two pieces at most."""
        known, piece, whole = self.known, self.piece, []
        for word in new:
            letters = word.rstrip(_MARKS)
            if not letters:
                known[word] = piece(word)
            elif letters.isalpha() and max(letters) <= _LAST_PLAIN:
                small = letters.lower()
                ids = known.get(small) or piece(small)
                marks = word[len(letters) :]
                known[word] = ids + (known.get(marks) or piece(marks)) if marks else ids
            else:
                whole.append(word)
        for word, found in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            known[word] = array("I", found.ids).tobytes()


def _piece_encoder(path: str):
    """Ids of pieces of the vocabulary's pattern: runs of plain small letters, or of marks, or digits.

    The vocabulary marks the last byte of a piece. That mark is written as a byte 0 behind
    each piece, which such pieces do not hold, so that a library without such marks can run
    the same merges: a byte and its mark come before any other pair. A byte 0 behind another
    is nothing.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    back = {symbol: byte for byte, symbol in byte_symbols().items()}
    ranks = {}
    for token, at in model["vocab"].items():
        plain = bytes(back[c] for c in token.removesuffix(model["end_of_word_suffix"]))
        ranks[plain + b"\0" if token.endswith(model["end_of_word_suffix"]) else plain] = at
    encode = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda piece: array("I", encode(piece + "\0")).tobytes()


def words(path: str) -> Words:
    return kept_in_worker(("words", path), lambda: Words(path))


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """``(part, first, doc_id, n, ids)``: ids as little-endian 32-bit bytes, ``first`` counted inside the partition."""

    def run(batches):
        encoder, part, first = words(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = encoder.encode(texts(batch))
            sizes = np.array([len(row) // 4 for row in ids], np.int64)
            ends = first + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(ends - sizes),
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array(ids, pa.binary()),
                ],
                ["part", "first", "doc_id", "n", "ids"],
            )
            first = int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"part int, first bigint, doc_id {kind}, n bigint, ids binary"
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document inside a window.

    ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` and, unless
    left out, the piece's ``ids``.
    """
    tokens = cut_lineage(token_rows(docs, path))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per partition of the input: the only thing that every task gets.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    places = cut_lineage(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")))
    placed = tokens.join(F.broadcast(places), "part").select(
        "doc_id", "n", "ids", (F.col("before") + F.col("first")).alias("place")
    )

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in slices(batches, "ids"):
            rows, pieces, kept = [], [], []
            columns = (batch.column("n").to_pylist(), batch.column("place").to_pylist(), batch.column("ids").to_pylist())
            for at, (n, place, ids) in enumerate(zip(*columns)):
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append(at)
                    pieces.append((start, length, zlib.crc32(piece), n, sequence, offset))
                    if with_ids:
                        kept.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    start += length
            if not rows:
                continue
            numbers = np.array(pieces, np.int64).T
            arrays = [batch.column("doc_id").take(pa.array(rows)), *(pa.array(column) for column in numbers)]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{name} bigint" for name in names[1:]) + ", ids array<int>" * with_ids
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids, pieces)``: the windows themselves, and their boundary records in order.

    A group is one window, so it holds at most ``window`` ids.
    """
    record = F.struct("offset", "doc_id", "start", "length", "ids")
    return (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(record)).alias("records"))
        .select(
            "sequence_id",
            F.flatten(F.transform("records", lambda r: r["ids"])).alias("ids"),
            F.transform("records", lambda r: r.dropFields("ids")).alias("pieces"),
        )
    )
