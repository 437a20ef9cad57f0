"""Memory of the Python workers, which stay for the tasks that follow."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system: Arrow's pool and, where the C library can, its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run):
    """``run`` over batches or frames that gives freed memory back before each next one and at its end.

    A worker otherwise keeps the most that any of its tasks, of any stage, needed at once, and
    counts with it for its executor while other stages run.
    """
    def released(batches):
        def fed():
            for batch in batches:
                yield batch
                del batch
                release()

        try:
            yield from run(fed())
        finally:
            release()
    return released
