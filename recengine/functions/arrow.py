"""Arrow list and binary columns of one width as numpy matrices, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column whose lists have one width as a matrix of doubles (a copy that may be written to)."""
    flat = np.array(column.flatten(), np.float64)
    return flat.reshape(len(column), -1 if width is None else width)


def list_array(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * width, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def binary_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column made by ``binary_array`` as a matrix (not to be written to); nulls are left out."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else [0, 0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(np.float64).reshape(-1, width) if at[-1] > at[0] else np.zeros((0, width))


def binary_array(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix of doubles as a binary column: cheaper than lists where only numpy reads them."""
    n, width = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(8 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix, np.float64))])
