"""Synthetic matrices for simulations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gaussian(spark: SparkSession, n: int, p: int, seed: int = 0) -> DataFrame:
    """Complex standard normal rows ``session_id, t, re[], im[]``."""
    re = F.array(*[F.randn(seed * 1000 + i) for i in range(p)])
    im = F.array(*[F.randn(seed * 1000 + 500 + i) for i in range(p)])
    return spark.range(n).select(F.lit("s0").alias("session_id"), F.col("id").cast("int").alias("t"), re.alias("re"), im.alias("im"))


def planted(spark: SparkSession, n: int, p: int, spread: list[float], sessions: int = 4, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Rows with known principal directions: deviations ``spread`` first, 1 elsewhere; and these directions."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((p, p)) + 1j * rng.standard_normal((p, p)))[0]
    scale = np.ones(p)
    scale[: len(spread)] = spread
    z = (rng.standard_normal((n, p)) + 1j * rng.standard_normal((n, p))) / np.sqrt(2) * scale
    x = z @ q.conj().T
    rows = [(f"s{i % sessions}", i, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "session_id string, t int, re array<double>, im array<double>")
    return df, q[:, : len(spread)]
