"""What Python workers keep between batches and stages: Spark keeps a worker, and the worker what it has freed."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; after each batch that it returns, and at its end, freed memory is given back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for out in run(batches):
            yield out
            out = None
            give_back()
        give_back()

    return work
