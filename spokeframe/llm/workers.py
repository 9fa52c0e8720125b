"""What Python workers remember between tasks.

Spark hands a worker process from one job's tasks to the next one's. Tables that are
costly to make (a tokenizer and its pieces) stay in it from task to task; a job that does
not use them drops them first, so that a chain of operators does not add them up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa

_CACHES: list = []


def remembered(maxsize: int) -> Callable:
    """``lru_cache`` whose entries :func:`forget` drops."""

    def wrap(function: Callable) -> Callable:
        cached = lru_cache(maxsize)(function)
        _CACHES.append(cached)
        return cached

    return wrap


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forget(*but: Callable) -> None:
    """Drop all that is remembered in this process, except by ``but``, and give back freed memory."""
    dropped = False
    for cached in _CACHES:
        if cached not in but and cached.cache_info().currsize:
            cached.cache_clear()
            dropped = True
    if dropped:
        gc.collect()
    give_back()
