"""Fixed-width packing of token ids, vectorised both ways.

Id number i takes bits i*width to (i+1)*width of a little-endian bit string, so any
stretch can be read without what comes before it.
"""

from __future__ import annotations

import numpy as np

_64 = np.uint64(64)


def width_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if not len(ids):
        return b""
    ids = np.asarray(ids, np.uint64)
    if int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit {width} bits")
    bit = np.arange(len(ids), dtype=np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(ids << shift, first)
    spill = shift + np.uint64(width) > _64
    words[word[spill] + 1] |= ids[spill] >> (_64 - shift[spill])
    return words.tobytes()[: (len(ids) * width + 7) // 8]


def unpack(packed: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` as uint32; reads only the bytes that hold them."""
    if not count:
        return np.zeros(0, np.uint32)
    low = start * width // 8
    part = packed[low : ((start + count) * width + 7) // 8]
    words = np.frombuffer(part + bytes(16 - len(part) % 8), "<u8")
    bit = np.arange(count, dtype=np.uint64) * np.uint64(width) + np.uint64(start * width - 8 * low)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    ids = words[word] >> shift
    spill = shift + np.uint64(width) > _64
    ids[spill] |= words[word[spill] + 1] << (_64 - shift[spill])
    return (ids & np.uint64((1 << width) - 1)).astype(np.uint32)
