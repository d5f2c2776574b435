"""Columns over ``ARRAY<INT>`` token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START_ID = 0
END_ID = 1
UNKNOWN_ID = 2
FIRST_TOKEN_ID = 3
TERMINAL = -1

_SALT = 7919


def truncate_tokens(ids: Column, max_length: int, end_id: int | None = END_ID) -> Column:
    """At most ``max_length`` ids; an end id, when there is one, stays last."""
    if end_id is None:
        return F.slice(ids, 1, max_length)
    return F.concat(F.slice(ids, 1, max_length - 1), F.array(F.lit(end_id)))


def full_chunks(ids: Column, max_length: int) -> Column:
    """``ARRAY<ARRAY<INT>>`` of whole chunks; what is left over is not kept."""
    n = F.floor(F.size(ids) / max_length).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(ids, (i - 1) * max_length + 1, max_length))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<int>>"))


def frame_sequence(ids: Column) -> Column:
    """Start id in front. The terminal marker and the document id are columns, not elements."""
    return F.concat(F.array(F.lit(START_ID)), ids)


def cut_at_pad(ids: Column) -> Column:
    """The first element, then everything before the next 0."""
    rest = F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))
    at = F.array_position(rest, F.lit(START_ID)).cast("int")
    return F.when(at > 0, F.slice(ids, 1, at)).otherwise(ids)


def prefix_hashes(ids: Column, depth: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the first ``depth`` ids.

    Together they are a 128-bit key of fixed size, so the index does not repeat
    every prefix as an array.
    """
    head = F.slice(ids, F.lit(1), depth)
    return F.xxhash64(head), F.xxhash64(F.lit(_SALT), head)
