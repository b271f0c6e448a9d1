"""Memory of tasks and their workers, and broadcasts that end with the step they serve."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import SparkSession

T = TypeVar("T")

#: Rows that a task is sent at a time where rows hold whole texts and several tasks share an executor.
ROWS = 1000

_sent: list[list] = []


def once(name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once per process under ``name``.

    Functions of this package travel to the workers by value, so globals of their modules end with a task, and what such globals
    hold on the driver would travel too; this store does neither.
    """
    held = sys.modules.setdefault("tidelearn_worker_store", types.ModuleType("tidelearn_worker_store")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def give_back() -> None:
    """Returns freed memory to the machine; for the end of a task, as its worker stays for the next one."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextmanager
def few_rows(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """Batches of ``rows`` rows for the jobs that run meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stay_few(spark: SparkSession, rows: int = ROWS) -> None:
    """Batches of at most ``rows`` rows from now on, for a table that is handed out before it is computed."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, before) if before > 0 else rows))


def send(spark: SparkSession, value):
    """A broadcast that the innermost ``released`` block destroys at its end."""
    sent = spark.sparkContext.broadcast(value)
    if _sent:
        _sent[-1].append(sent)
    return sent


@contextmanager
def released() -> Iterator[None]:
    """Destroys what is sent meanwhile; tables that need it must be written inside."""
    _sent.append([])
    try:
        yield
    finally:
        for sent in _sent.pop():
            sent.destroy()
