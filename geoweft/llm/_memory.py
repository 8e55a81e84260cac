"""Memories of Python workers.

A worker outlives its tasks, beside a JVM that fills its heap.  So what a task gathers is dropped at the
end of that task, and what an operator keeps for its next task goes when another operator starts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

_held: dict[str, Callable[[], None]] = {}


def _trim() -> None:
    """Freed pages go back to the system, where the C library can do that."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hold(owner: str, drop: Callable[[], None]) -> None:
    """``owner`` fills a memory from here on; the memories of other owners in this process are dropped."""
    others = [o for o in _held if o != owner]
    for other in others:
        _held.pop(other)()
    if others:
        _trim()
    _held[owner] = drop


@contextmanager
def task(*clear: Callable[[], None]) -> Iterator[None]:
    """What the task gathered is dropped by ``clear`` when it ends, also when it fails."""
    try:
        yield
    finally:
        for drop in clear:
            drop()
        _trim()


def slices(batches, rows: int = 500):
    """Parts of Arrow batches of at most ``rows`` rows, without a copy."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
