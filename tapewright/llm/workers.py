"""What Python workers give back: Spark keeps them from task to task, and what they hold counts against their executor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return memory that Arrow has freed but still holds to the system."""
    pa.default_memory_pool().release_unused()


def tidy(run: Run) -> Run:
    """A function for ``mapInArrow`` after whose last batch the worker holds no unused memory of Arrow's."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
