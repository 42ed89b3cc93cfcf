"""What a Python worker keeps from task to task."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

T = TypeVar("T")
Batches = Iterator[pa.RecordBatch]

BATCH_BYTES = 2 << 20  # about, of a batch between an executor and its workers; both hold several, outside the heap
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(rows: DataFrame, run: Callable[[Batches], Batches], schema: StructType | str, keeps: str = "") -> DataFrame:
    """``rows.mapInArrow`` with a lean ``run`` and batches of ``BATCH_BYTES``, by bytes and not by 10,000 rows of any width.

    The session's own batch setting stands where it has one; else it has this one from now on.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return rows.mapInArrow(lean(run, keeps), schema)


def parts(batch: pa.RecordBatch) -> Batches:
    """The rows of a batch, in order, in batches of equally many rows and about ``BATCH_BYTES``."""
    if batch.nbytes <= BATCH_BYTES:
        yield batch
        return
    rows = max(1, batch.num_rows * BATCH_BYTES // batch.nbytes)
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def lean(run: Callable[[Batches], Batches], keeps: str = "") -> Callable[[Batches], Batches]:
    """``run``, before which the worker drops what operators other than ``keeps`` kept, and after which it gives the memory
    that it no longer uses back to the system. What ``run`` makes goes to the executor in ``parts``.

    Workers outlive their tasks; what allocators hold for them would be missing in the tasks of other operators.
    """

    def then_release(batches: Batches) -> Batches:
        only(keeps)
        for made in run(batches):
            yield from parts(made)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim is not None:
            trim(0)

    return then_release


def only(operator: str) -> dict:
    """What this worker keeps for ``operator``; what others kept goes, so that a worker of many jobs holds the values of one.

    Functions arrive in tasks with globals of their own, so what outlives a task is kept in the interpreter's ``sys``.
    """
    kept = sys.__dict__.setdefault("_postgrain_kept", {})
    for other in [k for k in kept if k != operator]:
        del kept[other]
    return kept.setdefault(operator, {})


def per_worker(key: tuple, make: Callable[[], T]) -> T:
    """The value made for ``key`` by this worker before, else a new one. ``key`` begins with the operator's name."""
    kept = only(key[0])
    if key not in kept:
        kept[key] = make()
    return kept[key]
