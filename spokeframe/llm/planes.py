"""Integer and float arrays as short binary values: bytes by their place, then zstd.

Sorted numbers are stored as differences. Their high bytes are then mostly zero, and a
plane of zeros costs next to nothing.
"""

from __future__ import annotations

import numpy as np
import zstandard

_FAST = 1


def shrink(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=_FAST).compress(raw)


def grow(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def to_planes(values: np.ndarray) -> bytes:
    """``values`` of a fixed-width type; :func:`from_planes` needs the same type."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), width)
    return shrink(np.ascontiguousarray(raw.T).tobytes())


def from_planes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(grow(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def rising_to_planes(values: np.ndarray) -> bytes:
    """Numbers that never fall, as their differences."""
    return to_planes(np.diff(np.asarray(values, np.uint64), prepend=np.uint64(0)))


def rising_from_planes(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)
