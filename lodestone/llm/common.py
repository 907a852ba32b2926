"""What the operators of this subpackage share: written intermediate tables, memory of Python workers and small SQL pieces."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path, materialize, shared_dir

__all__ = ["fresh_path", "materialize", "shared_dir"]

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of rows that are sent to a Python worker at once: it and the JVM each hold a few such batches.
BATCH, _BATCH_KEY, _BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Set the size of batches to BATCH for the session, unless it has a size of its own."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH)


def give_back() -> None:
    """Return freed memory to the system: Python workers live from task to task, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """run, for mapInArrow or applyInArrow, that gives back what it freed when its task, or its group, is done."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def task(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

        return task

    @functools.wraps(run)
    def group(table):
        try:
            return run(table)
        finally:
            give_back()

    return group


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACE; none for a null text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def lines(text: Column) -> Column:
    """The lines of a text between line feeds; none for a null text, one empty line for an empty one."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def normal_line(line: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows
