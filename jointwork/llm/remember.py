"""What a Python worker keeps between tasks: the cache of one operator at a time.

Workers live longer than stages, so a cache that nobody uses any more would
take the memory of the next operator.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """The object kept under ``key``; another key drops what was kept before."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Drop the cache and give the memory back to the system, as far as its allocators can."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
