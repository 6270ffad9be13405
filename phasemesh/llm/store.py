"""Small helpers used by the operators: bounded batches, memos, ids, columns and files.

Tables and binary shards that one task writes and another reads lie in the shared folder, see :mod:`phasemesh.scratch`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Arrow batches are closed at this size, so that long texts do not pile up in a Python worker.
ARROW_BYTES = 16 << 20
#: Input bytes for each core under which a table counts as small.
SMALL_BYTES = 16 << 20
#: So many ids (16 MB) may be broadcast to pick out rows; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


_MEMOS: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called by a task that keeps a memo in its Python worker: the memos of other operators are emptied first, so that a
    worker that serves one stage after the other holds one memo at a time.
    """
    _MEMOS[name] = clear
    if _OWNER != [name]:
        for other, empty in _MEMOS.items():
            if other != name:
                empty()
        _OWNER[:] = [name]
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, where its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Close Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch(tmp: Scratch | None, spark: SparkSession, name: str) -> Scratch:
    """The caller's scratch folder, or one that is left behind for a plan that reads it later."""
    return tmp or Scratch(spark, name)


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores (a file may be one row group, which one task reads) dealt out
    anew; any other table as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES and len(df.inputFiles()) < cores else df


def semi(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``ids(key)``, a saved table: broadcast if it is small, else joined by shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI; used on the driver and in tasks alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; null where the id is null."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, each once: other columns, and second ones of a name that differs only by case, are left out."""
    first = {}
    for i, name in enumerate(df.columns):
        first.setdefault(name, i)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{first[n]}").alias(n) for n in names])
