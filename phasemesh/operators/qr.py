"""Triangular factors of distributed matrices by a tree of QR factorisations, and what follows from them.

The factor R of a tall matrix (X = Q R) has its singular values and right singular vectors; X^H X, whose condition is that of
X squared, is never made.  A task keeps one triangle and factors it anew with each batch of rows under it; the triangles of
all tasks are combined the same way, FAN groups first.  Few rows of very many variables are treated as their transpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import packed

#: A triangle is held whole: at most so many variables (64 MB), or rows of a wide matrix.
WIDEST = 2000


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r")


def _given(r: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([packed.task()]), pa.array([n]), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], schema=packed.SCHEMA)


class _Tall:
    """The triangle of a task's rows."""

    def __init__(self, p: int):
        self.p = p

    def __call__(self, batches):
        from .linalg import rows

        r, held, n = np.zeros((0, self.p), np.complex128), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(rows(batch))
                n += batch.num_rows
                if sum(map(len, held)) >= 2 * self.p:
                    r, held = _triangle(np.vstack([r, *held])), []
        if n:
            yield from _given(_triangle(np.vstack([r, *held])), n)


class _Wide:
    """The triangle of the transpose of a few rows (numbered ``i``), over a task's ranges of variables."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, batches):
        from .linalg import ranges

        r, n = np.zeros((0, self.n), np.complex128), 0
        for x in ranges(batches, self.n):
            r = _triangle(np.vstack([r, x.conj().T]))
            n += x.shape[1]
        if n:
            yield from _given(r, n)


def _stack(p: int):
    def merge(_: int, a: np.ndarray, __: int, b: np.ndarray) -> np.ndarray:
        return _triangle(np.vstack([v.view(np.complex128).reshape(-1, p) for v in (a, b)])).reshape(-1).view(np.float64)

    return merge


def r_factor(x: DataFrame) -> np.ndarray:
    """R of ``x(re[], im[])``, of at most WIDEST variables; no rows raise."""
    row = x.select(F.size("re").alias("p")).first()
    if row is None:
        raise ValueError("the matrix has no rows")
    if (p := int(row["p"])) > WIDEST:
        raise ValueError(f"a triangle is for up to {WIDEST} variables, not {p}; use randomised()")
    flat, _ = packed.fetch(x.select("re", "im").mapInArrow(_Tall(p), packed.FIELDS), _stack(p))
    return flat.view(np.complex128).reshape(-1, p)


def singular(x: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and their right singular vectors, to working precision."""
    from .linalg import fix_phase

    s, vh = np.linalg.svd(r_factor(x), full_matrices=False)[1:]
    return s[:k], fix_phase(vh.conj().T[:, :k])


def singular_of_few(x: DataFrame, places: DataFrame, keys: list[str], n: int, k: int, width: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The same of few rows of any number of variables: those of ``x(keys..., re[], im[])`` that ``places(keys..., i)`` numbers
    from 0 to before n.  Their variables are cut into ranges that are dealt over tasks; a task holds one range of all rows.
    """
    from .linalg import cut_ranges, fix_phase, project

    if n > WIDEST:
        raise ValueError(f"a triangle is for up to {WIDEST} rows, not {n}")
    spark = x.sparkSession
    with Scratch(spark, "few-rows") as tmp:
        known = tmp.save(x.join(F.broadcast(places), keys).select("i", "re", "im"), "rows")  # as many as places
        flat, _ = packed.fetch(cut_ranges(known, width).mapInArrow(_Wide(n), packed.FIELDS), _stack(n))
        # the rows are R^H Q^H: their left singular vectors are those of R^H
        u, s, _ = np.linalg.svd(flat.view(np.complex128).reshape(-1, n).conj().T, full_matrices=False)
        u, s = u[:, :k], s[:k]
        w = project(known, u)
    good = s > 1e-14 * s[:1]
    w[:, good] /= s[good]
    if not good.all():  # rows of lower rank: any directions at right angles to the others
        rng = np.random.default_rng(0)
        w[:, ~good] = rng.standard_normal((len(w), int((~good).sum())))
        w[:, ~good] = np.linalg.qr(np.hstack([w[:, good], w[:, ~good]]))[0][:, good.sum() :]
    return s, fix_phase(w)
