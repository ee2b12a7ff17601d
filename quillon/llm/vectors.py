"""Vectors as Arrow batches of packed eight-byte numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lists are there and wholly finite, the lists' lengths, and all components one after another."""
    flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = owners(sizes)[~np.isfinite(flat)]
    keep = lists.is_valid().to_numpy(zero_copy_only=False)
    keep[bad] = False
    return keep, sizes, flat


def owners(sizes: np.ndarray) -> np.ndarray:
    """The row of each component."""
    return np.repeat(np.arange(len(sizes)), sizes)


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Eight-byte numbers as a binary value for each row, without a copy."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def matrix(values: pa.Array, size: int, kind: type = np.float64) -> np.ndarray:
    """Rows of equal size, packed as by ``packed``."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), size)


def by_size(batch: pa.RecordBatch, column: str = "size"):
    """Parts of a batch of equal vector length."""
    sizes = batch.column(column).to_numpy()
    for size in np.unique(sizes).tolist():
        yield size, batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))
