"""Repeated passages by suffix arrays: remove every byte of a long string that occurs twice.

A string of 200 bytes and its copies have the same least 32-byte gram, so they have the
same anchor. Runs of neighbouring start positions with one anchor are the unit of work:

1. One pass over the texts lists the runs (anchor, hash of the run's bytes, place).
2. Anchors of one run that does not repeat itself cannot hold a repeat; they go. Runs with equal bytes repeat
   each other as a whole; their positions are marked without looking at the bytes again.
3. Only runs that share an anchor but differ are read and sorted. The runs of many anchors
   are laid one after the other and their suffix array is built in two stages: suffixes
   smaller than their successors are sorted directly, the others follow from them by
   scanning the buckets of the first byte. Neighbours of the array with a common prefix of
   200 bytes are repeats.
   An anchor with very many different runs (the edges of a passage that many documents
   share) would be one large group. Its runs are first split by longer and longer anchors,
   each of them in no more than two, until few runs share one.
4. Marks are merged per document into removed spans.

Defined results: texts are UTF-8 bytes, a null is an empty text; texts shorter than the
length lose nothing; repeated rows are copies of each other and lose all they can; a null
``doc_id`` is carried as it is; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import bloom
from rankloom.llm.common import kept_in_worker, row_key, slices, texts
from rankloom.llm.minhash import mix
from rankloom.session import cut_lineage

LENGTH = 200
GRAM = 32
# A run of more positions is cut, so that texts of one repeated word stay in small rows.
RUN_POSITIONS = 256
# Different runs of one anchor that are sorted together; more are split by longer anchors first.
GROUP_RUNS = 256
# Bytes laid together for one suffix array.
ARRAY_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[at] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, from prefix sums."""
    n = len(data)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    covered = 1
    while covered * 2 <= width:
        values = np.minimum(values[:-covered], values[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors, starts and sizes (in positions) of the runs of a text of at least ``length`` bytes,
    and whether a run may hold two equal strings itself (where it does, it says so)."""
    grams = gram_hashes(data, gram)
    least = sliding_min(grams, length - gram + 1)
    cuts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]))
    sizes = np.diff(cuts)
    starts = cuts[:-1]
    if sizes.max(initial=0) > RUN_POSITIONS:
        parts = -(-sizes // RUN_POSITIONS)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + sizes, parts)
        starts = np.repeat(starts, parts) + within * RUN_POSITIONS
        sizes = np.minimum(RUN_POSITIONS, ends - starts)
    # Equal strings of one run are less than RUN_POSITIONS apart, so all grams of the first,
    # of which every step-th is looked at, come again at that distance.
    step = (length - gram + 1) // 2
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate((grams[1:], np.zeros(RUN_POSITIONS, np.uint64))), RUN_POSITIONS - 1)
    again = np.flatnonzero((ahead[: len(grams) : step] == grams[::step, None]).any(axis=1)) * step
    inner = np.searchsorted(again, starts) < np.searchsorted(again, starts + sizes + length)
    return least[starts].view(np.int64), starts, sizes, inner


def all_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(anchor, bytes_hash, key_id, key_text, start, size, inner)``."""
    names = ["anchor", "bytes_hash", "key_id", "key_text", "start", "size", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker(("runs",), object)
        for batch in slices(batches):
            made = []
            for at, text in enumerate(texts(batch)):
                raw = text.encode()
                if len(raw) < length:
                    continue
                anchors, starts, sizes, inner = runs_of(np.frombuffer(raw, np.uint8), length, gram)
                ends = starts + sizes + length - 1
                hashes = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                made.append((anchors, np.array(hashes, np.uint64).view(np.int64), np.full(len(starts), at), starts, sizes, inner))
            if made:
                anchors, hashes, rows, starts, sizes, inner = (np.concatenate(column) for column in zip(*made))
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors),
                        pa.array(hashes),
                        batch.column("key_id").take(rows),
                        batch.column("key_text").take(rows),
                        pa.array(starts.astype(np.int32)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(inner),
                    ],
                    names,
                )

    return docs.select(*row_key(), "text").mapInArrow(
        run, "anchor bigint, bytes_hash bigint, key_id bigint, key_text bigint, start int, size int, inner boolean"
    )


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from each position as one number that sorts like them."""
    padded = np.concatenate((data, np.zeros(8 + depth, np.uint8)))
    words = np.zeros(len(data) + depth, np.uint64)
    for at in range(8):
        words = (words << np.uint64(8)) | padded[at : at + len(words)]
    return words


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` (no byte 255; 0 sorts first) in the order of their first ``depth`` bytes at least.

    Two stages: suffixes smaller than their successors are sorted directly, the others
    are induced from them bucket by bucket.
    """
    n = len(data)
    words = _words(data, depth + 24)
    after = np.concatenate((data[1:], np.zeros(1, np.uint8)))
    differs = data != after
    # A suffix compares to its successor as the first unequal pair of bytes does.
    place = np.where(differs, np.arange(n), n - 1)
    first_unequal = np.minimum.accumulate(place[::-1])[::-1]
    smaller = data[first_unequal] < after[first_unequal]
    # Stage one: direct sort by 24 bytes at a time, going on only inside ties.
    ranks = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    bits = np.uint64(21)
    picked = np.flatnonzero(smaller)
    order = np.arange(len(picked))
    group = np.zeros(len(picked), np.int64)
    tied = np.ones(len(picked), bool)
    for at in range(0, depth, 24):
        which = np.flatnonzero(tied)
        if len(which) == 0:
            break
        positions = picked[order[which]] + at
        key = (ranks[positions] << (bits + bits)) | (ranks[positions + 8] << bits) | ranks[positions + 16]
        inner = np.lexsort((key, group[which]))
        order[which] = order[which][inner]
        key, old = key[inner], group[which]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])))
        # Groups are named by the place of their first member.
        group[which] = which[np.maximum.accumulate(np.where(new, np.arange(len(which)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        tied[which] = ~alone
    direct = picked[order]
    direct_buckets = np.searchsorted(data[direct], np.arange(257))
    # Stage two: in bucket order, put the greater predecessors of what has its place.
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    result: list[np.ndarray] = []

    def hand_on(found: np.ndarray, bucket: int) -> np.ndarray:
        """Predecessors of placed suffixes: later buckets keep theirs, the same bucket's are returned."""
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        codes = data[before]
        same, codes_later, later = before[codes == bucket], codes[codes > bucket], before[codes > bucket]
        if len(later):
            by_code = np.argsort(codes_later, kind="stable")
            later, codes_later = later[by_code], codes_later[by_code]
            edges = np.flatnonzero(np.concatenate(([True], codes_later[1:] != codes_later[:-1], [True])))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                waiting[int(codes_later[low])].append(later[low:high])
        return same

    # The end of the data is smaller than everything, so the last suffix is a greater one that starts its bucket.
    if n and not smaller[n - 1]:
        waiting[int(data[n - 1])].append(np.array([n - 1]))
    for bucket in range(256):
        parts = waiting[bucket]
        greater = np.concatenate(parts) if parts else np.empty(0, np.int64)
        mine = []
        while len(greater):
            mine.append(greater)
            greater = hand_on(greater, bucket)
        own = direct[direct_buckets[bucket] : direct_buckets[bucket + 1]]
        if len(own):
            hand_on(own, bucket)
        result.extend([*mine, own])
    return np.concatenate(result) if result else np.empty(0, np.int64)


def repeated_starts(data: np.ndarray, may_start: np.ndarray, length: int) -> np.ndarray:
    """For each position, whether its ``length`` bytes also start at another allowed position."""
    order = suffix_array(data, length)
    order = order[may_start[order]]
    if len(order) < 2:
        return np.zeros(len(data), bool)
    words = _words(data, length)
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        which = np.flatnonzero(same)
        same[which] = words[order[which] + at] == words[order[which + 1] + at]
    hit = np.zeros(len(data), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return hit


def _true_ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


_MARKS = "key_id bigint, key_text bigint, start int, size int"


def sorted_marks(work: DataFrame, length: int) -> DataFrame:
    """Marks of rows ``(anchor, key_id, key_text, start, n, data)``, all runs of an anchor in one partition."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        raw = b"\0".join(row[5] for row in rows) + b"\0"
        data = np.frombuffer(raw, np.uint8) + np.uint8(1)
        begins = np.concatenate(([0], np.cumsum([len(row[5]) + 1 for row in rows])))
        data[begins[1:] - 1] = 0
        may_start = np.zeros(len(data), bool)
        for begin, row in zip(begins.tolist(), rows):
            may_start[begin : begin + len(row[5]) - length + 1] = True
        hit = repeated_starts(data, may_start, length)
        marks = []
        for begin, row in zip(begins.tolist(), rows):
            for low, high in _true_ranges(hit[begin : begin + len(row[5]) - length + 1]):
                marks.append((row[1], row[2], row[3] + low, high - low))
        columns = list(zip(*marks)) if marks else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)], ["key_id", "key_text", "start", "size"]
        )

    def run(batches):
        held, size, last = [], 0, None
        for batch in slices(batches, "data"):
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if size >= ARRAY_BYTES and row[0] != last:
                    yield judged(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield judged(held)

    dealt = work.select("anchor", "key_id", "key_text", "start", "n", "data").repartition("anchor")
    return dealt.sortWithinPartitions("anchor").mapInArrow(run, _MARKS)


def _longer(work: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs split by what lies around their anchor, as runs of longer anchors.

    Of a string that holds an anchor of ``gram`` bytes, half of the other bytes at least lie
    behind it, or before it: the anchor grows to that side. Equal strings hold the anchor at
    the same place first, so they grow alike. ``at`` is where a run holds its anchor, or null
    where it must be looked for; a string's anchor is the first one in it.
    """
    more = -(-(length - gram) // 2)
    behind = length - gram - more

    def run(batches):
        for batch in slices(batches, "data"):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "key_id", "key_text", "start", "n", "at", "data"))
            for anchor, key_id, key_text, start, n, at, raw in zip(*columns):
                count = len(raw) - length + 1
                if at is None:
                    places = np.flatnonzero(gram_hashes(np.frombuffer(raw, np.uint8), gram).view(np.int64) == anchor).tolist()
                else:
                    places = [at]
                low = 0
                for place in places:
                    high = min(count, place + 1)
                    cut = min(high, max(low, place - behind))
                    for side, first, last, begin in ((0, low, cut, place - more), (1, cut, high, place)):
                        if first < last:
                            part = raw[first : last + length - 1]
                            grown = xxhash.xxh3_64_intdigest(raw[begin : begin + gram + more], 2 * gram + side)
                            rows.append((grown, xxhash.xxh3_64_intdigest(part), key_id, key_text, start + first, n, begin - first, part))
                    low = max(low, high)
            columns = list(zip(*rows)) if rows else [[]] * 8
            hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*hashes, *(pa.array(c, k) for c, k in zip(columns[2:], kinds))], ["anchor", "bytes_hash", *_WORK[1:5], "at", "data"])

    return work.mapInArrow(run, "anchor bigint, bytes_hash bigint, key_id bigint, key_text bigint, start int, n bigint, at int, data binary")


_WORK = ["anchor", "key_id", "key_text", "start", "n", "data"]


def split_anchors(work: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows ``(anchor, key_id, key_text, start, n, data)`` with few runs to an anchor, and marks found on the way.

    Runs of an anchor with more than ``GROUP_RUNS`` different ones are split by longer
    anchors, until few share one. At the latest the anchor is the whole string. Runs with
    equal bytes repeat each other and are taken once.
    """
    small = work.filter(F.col("kinds") <= GROUP_RUNS).select(*_WORK)
    rest = work.filter(F.col("kinds") > GROUP_RUNS).withColumn("at", F.lit(None).cast("int"))
    marks = None
    while gram < length and not rest.isEmpty():
        pieces = cut_lineage(_longer(rest, length, gram))
        gram += -(-(length - gram) // 2)
        one = F.min(F.struct("key_id", "key_text", "start", "at", "data")).alias("one")
        classes = cut_lineage(pieces.groupBy("anchor", "bytes_hash").agg(F.sum("n").alias("n"), one).select("anchor", "bytes_hash", "n", "one.*"))
        whole = classes.filter("n > 1").select("anchor", "bytes_hash")
        # Runs that stand for equal ones are marked already.
        equal = pieces.filter("n = 1").join(whole, ["anchor", "bytes_hash"])
        equal = equal.select("key_id", "key_text", "start", (F.octet_length("data") - (length - 1)).alias("size"))
        marks = equal if marks is None else marks.union(equal)
        groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        known = classes.join(groups.filter("least = 1 AND kinds > 1"), "anchor")
        small = small.union(known.filter(F.col("kinds") <= GROUP_RUNS).select(*_WORK))
        rest = known.filter(F.col("kinds") > GROUP_RUNS)
    return (small if marks is None else small.union(rest.select(*_WORK))), marks


def repeat_marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key_id, key_text, start, size)``: runs of start positions whose ``length`` bytes occur elsewhere too."""
    runs = cut_lineage(all_runs(docs, length, gram))
    seen = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_anchor"), F.max("inner").alias("any_inner"))
    shared = seen.filter("n_anchor > 1 OR any_inner").select("anchor")
    runs = cut_lineage(runs.join(shared, "anchor"))
    first = F.min(F.struct("key_id", "key_text", "start", "size")).alias("first")
    classes = cut_lineage(runs.groupBy("anchor", "bytes_hash").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), first))
    whole = cut_lineage(classes.filter("n > 1").select("anchor", "bytes_hash"))
    equal = runs.join(whole, ["anchor", "bytes_hash"]).select("key_id", "key_text", "start", "size")

    # Of the classes, those matter whose anchor has a run that has no equal, and another
    # run or the same one again to compare it with.
    groups = classes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.max("inner").alias("any_inner")
    )
    mixed = groups.filter("least = 1 AND (kinds > 1 OR any_inner)").select("anchor", "kinds")
    wanted = classes.join(mixed, "anchor").select("anchor", "kinds", "n", "first.*")
    by_row = wanted.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("anchor", "kinds", "n", "start", "size")).alias("wanted"))

    def cut(batches):
        for batch in slices(batches):
            rows = []
            columns = (texts(batch), *(batch.column(c).to_pylist() for c in ("key_id", "key_text", "wanted")))
            for text, key_id, key_text, wanted in zip(*columns):
                raw = text.encode()
                rows.extend(
                    (w["anchor"], w["kinds"], key_id, key_text, w["start"], w["n"], raw[w["start"] : w["start"] + w["size"] + length - 1])
                    for w in wanted
                )
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
            names = ["anchor", "kinds", "key_id", "key_text", "start", "n", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # A Bloom filter of bounded size picks the texts in the scan, so that others are not
    # shuffled. Repeated rows share a key and a text: either of them serves.
    by_row = cut_lineage(by_row)
    code = F.xxhash64("key_id", "key_text")
    _, chosen = bloom.holding(docs.select(*row_key(), "text"), by_row, code, code)
    keyed = chosen.join(by_row, ["key_id", "key_text"])
    work = cut_lineage(
        keyed.mapInArrow(cut, "anchor bigint, kinds bigint, key_id bigint, key_text bigint, start int, n bigint, data binary")
    )
    work, more = split_anchors(work, length, gram)
    found = equal.union(sorted_marks(work, length))
    return found if more is None else found.union(more)


def _covered(marks: list | None, length: int, n: int) -> np.ndarray:
    """Spans ``[begin, end)`` covered by strings at the marked starts, merged and in order."""
    if not marks:
        return np.empty((0, 2), np.int64)
    spans = np.array([(m["start"], m["start"] + m["size"] + length - 1) for m in marks], np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))
    return np.stack((spans[new, 0], np.minimum(ends[last], n)), axis=1)


def _marked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(own, marks)``: the rows' own columns as one struct, whatever their names, and their marks."""
    marks = repeat_marks(docs, length, gram)
    per_row = cut_lineage(marks.groupBy("key_id", "key_text").agg(F.collect_set(F.struct("start", "size")).alias("marks")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *row_key())
    # Rows that the filter refuses have no marks and are not joined.
    code = F.xxhash64("key_id", "key_text")
    made, chosen = bloom.holding(rows, per_row, code, code)
    joined = chosen.join(per_row, ["key_id", "key_text"], "left").select("own", "marks")
    if made is None:
        return joined
    free = rows.filter(~made.accepts(code)).select("own", F.lit(None).cast(per_row.schema["marks"].dataType).alias("marks"))
    return joined.union(free)


def repeat_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` per row; spans are byte offsets."""

    def run(batches):
        for batch in slices(batches, "own"):
            own, rows = batch.column("own"), []
            for text, marks in zip(own.field("text").to_pylist(), batch.column("marks").to_pylist()):
                raw = (text or "").encode()
                spans = _covered(marks, length, len(raw))
                edges = [0, *spans.ravel().tolist(), len(raw)]
                kept = sha256()
                for begin, end in zip(edges[::2], edges[1::2]):
                    kept.update(raw[begin:end])
                removed = int((spans[:, 1] - spans[:, 0]).sum())
                rows.append((len(raw), removed, len(spans), kept.hexdigest(), spans.tolist()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(
                [own.field("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _marked(docs.select("doc_id", "text"), length, gram).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; ``n_chars``, if there, is counted anew.

    A character that is removed in part is removed as a whole. Null texts stay null.
    """

    def run(batches):
        for batch in slices(batches, "own"):
            own, kept = batch.column("own"), []
            for text, marks in zip(own.field("text").to_pylist(), batch.column("marks").to_pylist()):
                if text is None or not marks:
                    kept.append(text)
                    continue
                raw = text.encode()
                spans = _covered(marks, length, len(raw)).tolist()
                parts, at = [], 0
                for begin, end in spans:
                    while begin > at and raw[begin] & 0xC0 == 0x80:
                        begin -= 1
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end += 1
                    parts.append(raw[at:begin])
                    at = max(at, end)
                kept.append(b"".join([*parts, raw[at:]]).decode())
            columns = [pa.array(kept, f.type) if f.name == "text" else own.field(f.name) for f in own.type]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in own.type])

    out = _marked(docs, length, gram).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
