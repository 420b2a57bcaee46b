"""Arrow string columns as numpy code-point arrays and back, a whole batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_codes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all rows in sequence, row offsets into them, validity).

    One decoding call serves the whole batch; row offsets come from counting lead bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    valid = np.asarray(column.is_valid())
    if len(column) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), valid
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, lead[offsets - offsets[0]], valid


def to_arrow(codes: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The string column of code points cut at row offsets; one encoding call for the batch."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(valid), [mask, pa.py_buffer(np.ascontiguousarray(at[offsets]).tobytes()), pa.py_buffer(data)]).cast(pa.string())
