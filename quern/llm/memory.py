"""Gives freed memory of Python workers back to the system.

A worker serves many tasks, and the allocators keep what a task freed; beside the JVM and
the other workers of an executor that adds up. These decorators return it after each task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's malloc_trim; nothing where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Return unused memory of Arrow's and the C library's allocators."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(of_batches: Callable) -> Callable:
    """A function of an iterator of batches that releases memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of_batches(batches)
        finally:
            release()

    return run


def tidy_group(of_table: Callable) -> Callable:
    """A function of one group's table that releases memory after it."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return of_table(table)
        finally:
            release()

    return run


def tidy_pair(of_tables: Callable) -> Callable:
    """A function of two cogrouped tables that releases memory after them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return of_tables(left, right)
        finally:
            release()

    return run
