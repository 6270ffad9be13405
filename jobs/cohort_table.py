"""The table of a cohort's recordings by subject and visit, from recordings that are kept as texts.

A recording is a row of a table with a text; its series is what the config makes of the text (by default the lengths of
its words).  Its displacement is the mean absolute change between neighbours.  The job puts each subject's visits side by
side, leaves out other visits and subjects without both, marks those whose mean lies over the site's 95 % quantile, and
writes below the output

* ``table/site=S``: ``subject, meanFD_V1, length_V1, meanFD_V2, length_V2, agg, is_out``;
* ``missing/site=S``: ``subject, V1, V2``, whether each visit of a subject that is left out was recorded;
* ``sites``: ``site, n, n_out, limit, low, q1, median, q3, high`` of the subjects' means.

Everything is computed anew and overwritten, so a second run, or one after a failure, leaves the same tables.

    spark-submit --py-files ... jobs/cohort_table.py IN OUT [--config FILE]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import begin_log, config, log
from phasemesh.operators import evar, motion

JOB = "cohort_table"


def recordings(table: DataFrame, said: dict) -> DataFrame:
    """``site, subject, visit, moved, steps, frames`` of each recording: the sum of absolute changes, their number, and the
    number of frames.  Texts are turned into numbers where they are; only these sums are shuffled.
    """
    found = table.where(said["where"]).select(*[F.expr(said[c]).alias(c) for c in ("site", "subject", "visit")], F.expr(said["series"]).alias("y"))
    found = found.where("visit IS NOT NULL").withColumn("steps", F.greatest(F.size("y") - 1, F.lit(0)))
    changes = F.zip_with(F.slice("y", F.lit(2), F.col("steps")), F.slice("y", F.lit(1), F.col("steps")), lambda a, b: F.abs(a - b))
    return found.select("site", "subject", "visit", F.aggregate(changes, F.lit(0.0), lambda s, x: s + x).alias("moved"), "steps", F.coalesce(F.size("y"), F.lit(0)).alias("frames"))


def by_visit(found: DataFrame, visits: list[str]) -> DataFrame:
    """``site, subject, meanFD_V1, length_V1, ...``: all recordings of a visit together; null where there is no change to
    measure.
    """
    wanted = found.where(F.col("visit").isin(visits))
    sums = [F.try_divide(F.sum(F.when(F.col("visit") == v, F.col("moved"))), F.sum(F.when(F.col("visit") == v, F.col("steps")))).alias(f"meanFD_{v}") for v in visits]
    sums += [F.sum(F.when((F.col("visit") == v) & (F.col("frames") > 0), F.col("frames"))).alias(f"length_{v}") for v in visits]
    return wanted.groupBy("site", "subject").agg(*sums)


def _write(rows: DataFrame, path: str, files: int) -> None:
    """By site, each in so many files at most, however many rows one site has."""
    spread = rows.repartition("site", F.pmod(F.xxhash64("subject"), F.lit(files)))
    spread.sortWithinPartitions("site", "subject").write.mode("overwrite").partitionBy("site").parquet(path)


def run(spark: SparkSession, source: str, output: str, config_path: str | None = None) -> DataFrame:
    """Write the cohort's tables and give the main one as it was written.

    Rows without a subject (``where`` in the config) or a known visit are left out, null and empty texts are recordings
    without frames, rows that repeat count as often as they are there; an empty table gives empty ones.
    """
    said = config(spark, config_path, JOB)
    first, second = said["visits"]
    table = spark.read.parquet(source)
    found = recordings(table, said)
    wide = by_visit(found, said["visits"])
    files = said["files_per_site"]
    wide.write.mode("overwrite").parquet(f"{output}/subjects")
    wide = spark.read.schema(wide.schema).parquet(f"{output}/subjects")
    log.info("read %d subjects of %s", wide.count(), source)
    one, two = f"meanFD_{first}", f"meanFD_{second}"
    _write(motion.outliers(wide, one, two, float(said["level"]), ["site"]), f"{output}/table", files)
    _write(wide.where(F.col(one).isNull() | F.col(two).isNull()).select("site", "subject", *[F.col(c).isNotNull().alias(v) for c, v in ((one, first), (two, second))]), f"{output}/missing", files)
    kept = spark.read.schema(f"subject {dict(wide.dtypes)['subject']}, {one} double, {two} double, length_{first} long, length_{second} long, agg double, is_out boolean, site string").parquet(f"{output}/table")
    counts = kept.groupBy("site").agg(F.count("*").alias("n"), F.count_if("is_out").alias("n_out"))
    counts.join(evar.box(kept, "agg", "site"), "site").write.mode("overwrite").parquet(f"{output}/sites")
    for name in ("table", "missing", "sites"):
        log.info("wrote %s/%s", output, name)
    log.info("%d subjects with both visits", kept.count())
    return kept


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("source", help="Parquet table with texts")
    parser.add_argument("output")
    parser.add_argument("--config", help=f"JSON over the settings of {JOB}.json")
    parser.add_argument("--master", help="left to spark-submit if not given")
    said = parser.parse_args()
    begin_log()
    from phasemesh.session import session

    spark = session(said.master)
    try:
        run(spark, said.source, said.output, said.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
