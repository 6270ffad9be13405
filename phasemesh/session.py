"""Spark session with the settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, and one BLAS thread per task.  ``master`` is left to spark-submit
    where it is not given; ``partitions`` sets shuffle partitions (adaptive execution merges small ones).
    """
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    build = SparkSession.builder.appName("phasemesh")
    if master:
        build = build.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    }
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (base | conf).items():
        build = build.config(k, v)
    return build.getOrCreate()
