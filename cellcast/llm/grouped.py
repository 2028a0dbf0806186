"""Groups of a sorted partition, met batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches that hold whole groups only, and where each group starts and stops.

    The partition must be sorted by its first ``keys`` columns. The rows of a batch's last
    group wait for the next batch; so memory holds a batch and the longest group.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        both = waiting[0] if len(waiting) == 1 else pa.concat_batches(waiting)
        edges = _edges(both, keys)
        last = edges[-2]
        if last:
            yield both.slice(0, last), list(zip(edges[:-2], edges[1:-1]))
        waiting = [both.slice(last)]
    if waiting:
        both = waiting[0]
        edges = _edges(both, keys)
        yield both, list(zip(edges[:-1], edges[1:]))


def _edges(batch: pa.RecordBatch, keys: int) -> list[int]:
    """0, every row that differs from the row before in a key, and the number of rows."""
    differs = np.zeros(batch.num_rows - 1, bool)
    for i in range(keys):
        column = batch.column(i)
        values = column.to_numpy(zero_copy_only=False)
        if values.dtype == object:
            values = np.array(column.dictionary_encode().indices.fill_null(-1))
        differs |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(differs) + 1).tolist(), batch.num_rows]


def padded_lists(column: pa.ListArray, fill: int = 0) -> np.ndarray:
    """Lists of integers as rows of one width, ``fill`` after the end of each."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    out = np.full((len(column), int(sizes.max(initial=0))), fill, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat
    return out
