"""The best of a block of queries over a block of documents, in numpy, inside one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Scores are rounded before they are ranked, so that the order of a sum decides no tie.
SCORE_DIGITS = 9
# Far above the rounding, far below any digit that counts: what may still be among the best is rounded and compared.
_MARGIN = 1e-8

RUN_SCHEMA = "query_id string, corpus_id string, score double"
RUN_ARROW = pa.schema([("query_id", pa.string()), ("corpus_id", pa.string()), ("score", pa.float64())])


def id_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _first(rows: np.ndarray, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first entries of each row by score, then by place; sorted by row."""
    order = np.lexsort((places, -scores, rows))
    rows, places, scores = rows[order], places[order], scores[order]
    if not len(rows):
        return rows, places, scores
    begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    nth = np.arange(len(rows)) - np.repeat(begins, np.diff(np.r_[begins, len(rows)]))
    return rows[nth < k], places[nth < k], scores[nth < k]


def best_rows(
    query_ids: np.ndarray,
    doc_ids: np.ndarray,
    product: Callable[[slice, slice], np.ndarray],
    k: int,
    query_tile: int,
    doc_tile: int,
    positive: bool = False,
) -> Iterator[pa.RecordBatch]:
    """The ``k`` best documents of each query by score, then by id, both descending.

    ``doc_ids`` are in descending order. ``product`` gives the scores of a tile of queries and
    documents; of a tile only the scores that can still be among the best are kept, so a
    task holds one tile and some ``k`` entries a query of it. With ``positive`` other scores
    are no results. A document with the query's own id is left out.
    """
    place = {one: at for at, one in enumerate(doc_ids)}
    for start in range(0, len(query_ids), query_tile):
        ids = query_ids[start : start + query_tile]
        own = np.array([place.get(one, -1) for one in ids])
        least = np.full(len(ids), -np.inf)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for left in range(0, len(doc_ids), doc_tile):
            tile = product(slice(start, start + len(ids)), slice(left, min(left + doc_tile, len(doc_ids))))
            if positive:
                tile[tile <= 0] = -np.inf
            here = np.flatnonzero((own >= left) & (own < left + tile.shape[1]))
            tile[here, own[here] - left] = -np.inf
            bound = least
            if tile.shape[1] > k and np.isneginf(least).any():
                bound = np.maximum(least, np.partition(tile, tile.shape[1] - k, axis=1)[:, tile.shape[1] - k])
            rows, cols = np.nonzero(tile >= np.maximum(bound - _MARGIN, np.finfo(float).min)[:, None])
            scores = np.round(tile[rows, cols], SCORE_DIGITS)
            held = _first(np.r_[held[0], rows], np.r_[held[1], cols + left], np.r_[held[2], scores], k)
            full = np.bincount(held[0], minlength=len(ids)) >= k
            least[full] = held[2][np.searchsorted(held[0], np.flatnonzero(full), "right") - 1]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[held[0]], pa.string()), pa.array(doc_ids[held[1]], pa.string()), pa.array(held[2], pa.float64())],
                schema=RUN_ARROW,
            )
