"""What the operators of this subpackage share: tables, the shared folder, batches.

Lineage is cut by :func:`eddystream.session.stored`.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddystream.session import dropped, scratch, ship, stored  # noqa: F401  the operators take them from here

#: Rows and bytes of one Arrow batch: texts can be long, so rows are few.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: glibc's numbers for the size from which memory is mapped by itself, for what a heap keeps free at its top, and for the number of arenas.
M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX = -3, -1, -8
#: Blocks of this size are given back once freed, and of smaller ones twice as much is kept: with less, arrays cost more page faults than work.
KEPT_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small enough for a worker's memory, and sends this package to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # noqa: BLE001  a static setting in some versions
        pass


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` for mapInArrow, after which the worker, which Spark keeps for later tasks, gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_little()
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def keep_little() -> None:
    """Has this process return large blocks of memory as soon as they are free."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(M_MMAP_THRESHOLD, KEPT_BYTES)
        libc.mallopt(M_TRIM_THRESHOLD, 2 * KEPT_BYTES)
        libc.mallopt(M_ARENA_MAX, 2)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns can't interfere."""
    return df.select(*(F.col(f"`{n}`") for n in names))
