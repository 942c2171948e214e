"""Giving freed memory of a Python worker back to the system."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")


def release() -> None:
    """Return what numpy and Arrow have freed: workers outlive a stage, and an executor's share of memory is fixed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(items: Iterable[T]) -> Iterator[T]:
    """``items``, giving freed memory back before the first (what the worker's last task left), after each and at the end."""
    gc.collect()
    release()
    for item in items:
        yield item
        del item
        release()
