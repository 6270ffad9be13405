"""Sums of large arrays over all tasks, as packed blocks of rows that are combined in a tree.

A task's array (variables x numbers) is cut into blocks of at most BLOCK_BYTES; a block travels as bytes, with the rows it
was made of.  Blocks of the same place are combined first in FAN groups and then in one, each as a stream of batches, so a
worker holds two blocks at a time; what is shuffled is each task's array once, and FAN of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block, and groups in which blocks are combined first.
BLOCK_BYTES, FAN = 4 << 20, 16
FIELDS = "block long, part long, n long, data binary"
SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

Merge = Callable[[int, np.ndarray, int, np.ndarray], np.ndarray]


def rows_of(width: int) -> int:
    """Rows of ``width`` doubles in a block."""
    return max(1, BLOCK_BYTES // (8 * max(width, 1)))


def task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def give(total: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """A task's array, of doubles or complex numbers, as blocks; ``n``: the rows it was made of."""
    flat = np.ascontiguousarray(total).view(np.float64).reshape(len(total), -1)
    size, part = rows_of(flat.shape[1]), task()
    for block, at in enumerate(range(0, len(flat), size)):
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([n]), pa.array([flat[at : at + size].tobytes()], pa.binary())], schema=SCHEMA)


def add(_: int, a: np.ndarray, __: int, b: np.ndarray) -> np.ndarray:
    """Sums."""
    return a + b


def merge_moments(n: int, a: np.ndarray, m: int, b: np.ndarray) -> np.ndarray:
    """Real and imaginary means and centred sums of squares of n and of m rows, as rows of three numbers."""
    a, b = a.reshape(-1, 3), b.reshape(-1, 3)
    if not n or not m:
        return (a if n else b).reshape(-1)
    apart = b[:, :2] - a[:, :2]
    both = np.empty_like(a)
    both[:, :2] = a[:, :2] + apart * (m / (n + m))
    both[:, 2] = a[:, 2] + b[:, 2] + (apart**2).sum(1) * (n * m / (n + m))
    return both.reshape(-1)


def _combine(merge: Merge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block, part = None, 0, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block, part, m = (batch.column(k)[row].as_py() for k in range(3))
                new = np.frombuffer(batch.column(3)[row].as_buffer(), np.float64)
                held, n = (new.copy(), m) if held is None else (merge(n, held, m, new), n + m)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([n]), pa.array([held.tobytes()], pa.binary())], schema=SCHEMA)

    return run


def combined(made: DataFrame, merge: Merge = add) -> DataFrame:
    """One row for each block, of the blocks that all tasks gave."""
    some = made.groupBy("block", F.pmod("part", F.lit(FAN))).applyInArrow(_combine(merge), FIELDS)
    return some.groupBy("block").applyInArrow(_combine(merge), FIELDS)


def fetch(made: DataFrame, merge: Merge = add) -> tuple[np.ndarray, int]:
    """All blocks in order as one array of doubles on the driver, and the number of rows: the array's size is bounded by
    what a task could hold.
    """
    table = combined(made, merge).select("block", "n", "data").toArrow().sort_by("block")
    if not table.num_rows:
        return np.zeros(0), 0
    parts = [np.frombuffer(v.as_buffer(), np.float64) for v in table.column("data").combine_chunks()]
    return np.concatenate(parts), table.column("n")[0].as_py()
