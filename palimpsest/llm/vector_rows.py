"""Vectors in Arrow batches: matrices of the rows of one size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sizes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, start, size) of a list column; the size of a row that is null or holds a null or non-finite value is -1."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    size = np.diff(offsets)
    size[(bad[offsets[1:]] > bad[offsets[:-1]]) | np.asarray(column.is_null())] = -1
    return values, offsets[:-1], size


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each size of the vectors that are neither null nor hold a null or non-finite value."""
    values, start, size = sizes_of(column)
    for n in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == n)
        yield at, values[start[at][:, None] + np.arange(n)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, of rows that aren't zero; neither large nor tiny values overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
