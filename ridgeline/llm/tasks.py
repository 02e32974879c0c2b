"""Memory of Python tasks.

Spark keeps Python workers for later tasks, so what one task leaves behind counts against the
next.  Texts come in small Arrow batches, and a task gives freed memory back when it ends.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 1_000
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Have rows with texts reach Python ``ROWS`` at a time, unless the session says otherwise."""
    if spark.conf.get(_SETTING) == _DEFAULT:
        spark.conf.set(_SETTING, str(ROWS))


_kept: dict[tuple[str, str], Any] = {}


def kept(kind: str, name: str, make: Callable[[], Any]) -> Any:
    """What tasks of a kind leave to the next ones in this Python worker; a ``slim`` task of another kind lets go of it."""
    if (kind, name) not in _kept:
        _kept[kind, name] = make()
    return _kept[kind, name]


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go(keeps: str) -> None:
    """Drop what tasks of other kinds have left in this worker."""
    if others := [k for k in _kept if k[0] != keeps]:
        for k in others:
            del _kept[k]
        give_back()


def slim(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = ""):
    """For functions of ``mapInArrow``: return freed memory at the end of the task, and before it what it does not keep."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        yield from f(batches)
        give_back()

    return run
