"""Small helpers around Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty.

    The bytes are padded by 16 zeros, so windows may be read past the end.
    """
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    first, last = int(at[0]), int(at[-1])
    out = np.zeros(last - first + 16, np.uint8)
    if last > first:
        out[: last - first] = np.frombuffer(data, np.uint8, last - first, first)
    return out, at - first


def windows8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one integer, without copying."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
