"""Arrays of numbers as compact binary cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight are put side by side and compressed; small numbers take little room."""
    size = len(values).to_bytes(4, "little")
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T)
    return size + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def unpack(cell: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(cell[:4], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(memoryview(cell)[4:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(cell: bytes) -> np.ndarray:
    return np.cumsum(unpack(cell, U64), dtype=U64)
