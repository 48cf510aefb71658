"""Python workers live on between tasks: what a task has freed should go back to the machine."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def give_back() -> None:
    """Return freed memory of Python, Arrow and the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
