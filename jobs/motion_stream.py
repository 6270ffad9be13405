"""Keeps the displacement of a growing collection of sessions up to date.

Frames arrive as Parquet files in a folder.  Each run takes the files that no run has taken before (a stream with
``availableNow``, whose checkpoint also holds every session's last frame), and writes below the output

* ``displacement/batch=N/site=S``: ``session_id, t, fd, high, late``, one row for each frame with one before it;
* ``sums/batch=N``: ``session_id, n, late, sum_fd, max_fd, high``, which :func:`sessions` adds up by session.

A batch overwrites its own partitions only, so a batch that Spark runs again after a failure leaves the same rows once.
A frame that comes after a later one of its session was taken has no displacement; it is kept as a row with ``late``.
A session's new frames of one batch are put in order in one task, so ``files_per_batch`` bounds what a task may hold.

    spark-submit --py-files ... jobs/motion_stream.py IN OUT CHECKPOINT [--config FILE]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import begin_log, config, log, settings
from phasemesh.operators.motion import PARAMS
from phasemesh.streaming.motion import framewise_displacement

JOB = "motion_stream"
SUMS = "session_id string, n long, late long, sum_fd double, max_fd double, high long, batch long"
ROWS = "session_id string, t long, fd double, high boolean, late boolean, batch long, site string"


def _frames(spark: SparkSession, source: str, said: dict) -> DataFrame:
    """The stream of frames.  Its path is given as a pattern that fits ``source`` alone, since a stream takes a single file
    (the table may be one) only by a pattern.
    """
    place = source.rstrip("/")
    schema = spark.read.parquet(place).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", said["files_per_batch"]).parquet(f"{place[:-1]}[{place[-1]}]")
    named = [F.expr(e).cast("double").alias(p) for p, e in zip(PARAMS, said["parameters"], strict=True)]
    return stream.where(said["where"]).select(F.expr(said["session"]).alias("session_id"), F.expr(said["t"]).cast("long").alias("t"), *named)


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _batch(output: str, said: dict):
    def write(made: DataFrame, batch: int) -> None:
        made = made.persist()
        try:
            high = F.coalesce(F.col("fd") > F.lit(float(said["high"])), F.lit(False))
            rows = made.select("session_id", "t", "fd", high.alias("high"), "late", F.lit(batch).cast("long").alias("batch"), F.expr(said["site"]).alias("site"))
            _write(rows.repartition("site", F.pmod(F.xxhash64("session_id"), F.lit(said["state_partitions"]))), f"{output}/displacement", "batch", "site")
            sums = rows.groupBy("session_id").agg(
                F.count("fd").alias("n"), F.count_if("late").alias("late"), F.coalesce(F.sum("fd"), F.lit(0.0)).alias("sum_fd"), F.max("fd").alias("max_fd"),
                F.count_if("high").alias("high"), F.lit(batch).cast("long").alias("batch"),
            )
            _write(sums, f"{output}/sums", "batch")
            log.info("batch %d: %d rows of displacement written", batch, made.count())
        finally:
            made.unpersist()

    return write


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config_path: str | None = None) -> DataFrame:
    """Take what is new in ``source``, wait until it is written, and give all displacements (:func:`displacement`).

    An empty folder, and a run without new files, add nothing.  Rows without a session or value (``where`` in the config)
    are left out; columns that the config does not name are not read.
    """
    said = config(spark, config_path, JOB)
    # the number of state partitions is fixed with a checkpoint's first run
    with settings(spark, spark__sql__shuffle__partitions=str(said["state_partitions"])):
        made = framewise_displacement(_frames(spark, source, said), said["radius"], late=True)
        query = made.writeStream.foreachBatch(_batch(output, said)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    log.info("read %d new frames of %s in %d batches", sum(p.get("numInputRows", 0) for p in query.recentProgress), source, sum(p.get("numInputRows", 0) > 0 for p in query.recentProgress))
    found = displacement(spark, output)
    log.info("%s holds %d displacements", output, found.count())
    return found


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the output; without rows before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def displacement(spark: SparkSession, output: str) -> DataFrame:
    """All rows of displacement that runs have written."""
    return _read(spark, f"{output}/displacement", ROWS)


def sessions(spark: SparkSession, output: str) -> DataFrame:
    """``session_id, length, mean_fd, max_fd, high, late`` of every session, from the sums of all batches."""
    sums = _read(spark, f"{output}/sums", SUMS).groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("n", "late", "sum_fd", "high")], F.max("max_fd").alias("max_fd"))
    return sums.select("session_id", (F.col("n") + 1).alias("length"), F.expr("sum_fd / nullif(n, 0)").alias("mean_fd"), "max_fd", "high", "late")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("source", help="folder of Parquet files with frames")
    parser.add_argument("output")
    parser.add_argument("checkpoint")
    parser.add_argument("--config", help=f"JSON over the settings of {JOB}.json")
    parser.add_argument("--master", help="left to spark-submit if not given")
    said = parser.parse_args()
    begin_log()
    from phasemesh.session import session

    spark = session(said.master)
    try:
        run(spark, said.source, said.output, said.checkpoint, said.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
