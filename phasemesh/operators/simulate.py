"""Monte-Carlo runs of the solvers on matrices with known directions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources.synthetic import planted
from . import linalg

Solver = Callable[[DataFrame, int, int], np.ndarray]  # matrix, components, run -> loadings


def agreement(spark: SparkSession, solve: Solver, runs: int, n: int, p: int, spread: list[float]) -> DataFrame:
    """``run, pc, mcc``: agreement of each run's loadings with the exact ones of the same matrix."""
    rows = []
    for run in range(runs):
        x, _ = planted(spark, n, p, spread, seed=run)
        x = x.persist()
        want = linalg.exact(x, len(spread))
        rows += [(run, pc, float(m)) for pc, m in enumerate(linalg.mcc(want, solve(x, len(spread), run)))]
        x.unpersist()
    return spark.createDataFrame(rows, "run int, pc int, mcc double")


def agreement_on(x: DataFrame, solve: Solver, k: int, runs: int) -> DataFrame:
    """The same for several runs of a solver on one matrix."""
    want = linalg.exact(x, k)
    rows = [(run, pc, float(m)) for run in range(runs) for pc, m in enumerate(linalg.mcc(want, solve(x, k, run)))]
    return x.sparkSession.createDataFrame(rows, "run int, pc int, mcc double")


def by_oja(x: DataFrame, k: int, run: int) -> np.ndarray:
    p = len(x.first()["re"])
    return linalg.oja(x, linalg.start(p, k, run), 6, linalg.log_linear(1.0, 0.1, 6), take=5, seed=run).w


def by_pimvr(x: DataFrame, k: int, run: int) -> np.ndarray:
    return linalg.pimvr(x, linalg.sample_start(x, k, 100, run), 1, 3, 1e-3, seed=run).w


def real_oja(x: np.ndarray, k: int, rates: np.ndarray, seed: int = 0) -> np.ndarray:
    """Row-by-row Oja's rule on a small real matrix, with an orthonormal basis kept (for one component this is
    Karhunen's stochastic gradient with normalisation).
    """
    rng = np.random.default_rng(seed)
    w = np.linalg.qr(rng.standard_normal((x.shape[1], k)))[0]
    for row, rate in zip(x, rates):
        w = np.linalg.qr(w + rate * np.outer(row, row @ w))[0]
    return w


def shamir(x: np.ndarray, epochs: int, rate: float, seed: int = 0) -> np.ndarray:
    """First component of a small real matrix by single rows with the variance of each step reduced by an anchor."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal(x.shape[1])
    w /= np.linalg.norm(w)
    for _ in range(epochs):
        anchor = w.copy()
        full = x.T @ (x @ anchor) / len(x)
        for i in rng.integers(0, len(x), len(x)):
            w = w + rate * (x[i] * (x[i] @ w - x[i] @ anchor) + full)
            w /= np.linalg.norm(w)
    return w
