"""Helpers shared by the operators: tables, checkpoints, sizing, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtrail.sources.checkpoints import checkpoint
from revtrail.sources.landed import spread

__all__ = ["checkpoint"]

#: ASCII letters A-Z to a-z, all else unchanged (a 256-entry byte rule, not a word list).
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table, over all cores also where its files are too few for them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def free_name(taken: Iterable[str], stem: str) -> str:
    """``stem``, or stem_1, stem_2, ... if a column already has that name (case-insensitively)."""
    low = {x.lower() for x in taken}
    name, k = stem, 0
    while name.lower() in low:
        k += 1
        name = f"{stem}_{k}"
    return name


def give_back() -> None:
    """Returns freed memory of this worker process to the system: a reused worker would keep what its largest
    task took, next to an executor whose heap does not shrink either."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not a GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, over slices of at most ``rows`` rows (an Arrow batch may hold 64 MB of texts, and as
    Python objects a multiple of that), giving memory back at the end of the task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        finally:
            give_back()

    return wrapped


def crc32_mod(id_column: str, m: int):
    """crc32 of the id as text, modulo ``m`` (Spark's crc32 is the unsigned CRC-32)."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(m))
