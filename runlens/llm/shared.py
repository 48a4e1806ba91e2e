"""Tables in the shared folder, bounded Arrow maps, and joins on keys that may be hot."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.storage import fresh_path, write_table

__all__ = ["free_names", "fresh_path", "in_batches", "lookup", "write_table"]


#: Rows and bytes of an Arrow batch. Whole texts are long rows: Spark's default of 10,000 rows costs an executor
#: several copies of over 30 MB a task, outside the JVM's heap.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


class Batched:
    """A frame whose Arrow maps leave no idle memory behind: workers live on between tasks, several of them an executor."""

    def __init__(self, df: DataFrame, keep_words: bool):
        self.df, self.keep_words = df, keep_words

    def mapInArrow(self, run: Callable, schema: StructType | str) -> DataFrame:  # noqa: N802
        keep_words = self.keep_words

        def tidied(batches):
            if not keep_words:
                forget_words()
            try:
                yield from run(batches)
            finally:
                release_memory()

        return self.df.mapInArrow(tidied, schema)


def forget_words() -> None:
    """Drop what this worker knows of words, if it has encoded texts before, for another task."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens:
        tokens.forget()


def release_memory() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def in_batches(df: DataFrame, keep_words: bool = False) -> Batched:
    """``df``, after bounding the session's Arrow batches for what is mapped over it (smaller settings stay).

    ``keep_words``: what is mapped encodes texts, and goes on with the words that the worker knows.
    """
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return Batched(df, keep_words)


#: A key counts as hot when it holds over 1/HOT_SHARE of the rows, so there are under HOT_SHARE hot keys at any size.
HOT_SHARE = 1024


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join ``rows`` with ``groups`` (one row a key, ``size`` rows of ``rows`` each) without a hot task.

    The rows of hot keys, under HOT_SHARE of them by the definition above, meet a broadcast copy of those
    groups; all other keys hold at most total / HOT_SHARE rows each and are joined by a shuffle (in the way that
    ``hint`` names, if any).
    """
    floor = max(total // HOT_SHARE, 1)
    hot = groups.filter(F.col(size) > floor)
    rest = groups.filter(F.coalesce(F.col(size), F.lit(0)) <= floor)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = rest.hint(hint) if hint else rest
    return rows.join(F.broadcast(hot), key, "inner").unionByName(cold.join(rest, key, how))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has, however it is written."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        k, found = 0, name
        while found.lower() in taken:
            k, found = k + 1, f"{name}{k}"
        taken.add(found.lower())
        out.append(found)
    return out
