"""The jobs as registered queries: each runs twice into one new folder and gives the whole output, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemesh import scratch

from . import cohort_table, motion_stream


def job1_motion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every displacement, with its session's sums."""
    place = scratch.folder(spark, "job1")
    for _ in range(2):
        found = motion_stream.run(spark, f"{sf_dir}/events.parquet", f"{place}/out", f"{place}/checkpoint")
    known = motion_stream.sessions(spark, f"{place}/out").select("session_id", "length", F.round("mean_fd", 7).alias("mean_fd"), F.round("max_fd", 7).alias("max_fd"), F.col("high").alias("n_high"))
    return found.select("site", "session_id", "t", F.round("fd", 7).alias("fd"), "high", "late").join(known, "session_id")


JOB1 = """
WITH f AS (
  SELECT CAST(user_id AS VARCHAR) session_id, 'site' || (user_id % 4) site, event_id t, "value" p1, CAST(hour(ts) AS DOUBLE) / 24 p2, CAST(minute(ts) AS DOUBLE) / 60 p3,
    "value" / 1000 p4, CAST(event_id % 10 AS DOUBLE) / 1000 p5, CAST(hour(ts) AS DOUBLE) / 10000 p6
  FROM events WHERE "value" IS NOT NULL AND user_id IS NOT NULL)
, d AS (
  SELECT session_id, site, t, abs(p1 - lag(p1) OVER w) + abs(p2 - lag(p2) OVER w) + abs(p3 - lag(p3) OVER w)
    + 50 * (abs(p4 - lag(p4) OVER w) + abs(p5 - lag(p5) OVER w) + abs(p6 - lag(p6) OVER w)) fd
  FROM f WINDOW w AS (PARTITION BY session_id ORDER BY t))
, k AS (SELECT * FROM d WHERE fd IS NOT NULL)
, s AS (SELECT session_id, count(*) + 1 AS length, avg(fd) mean_fd, max(fd) max_fd, count(*) FILTER (fd > 10) n_high FROM k GROUP BY session_id)
SELECT site, k.session_id, t, round(fd, 7) fd, fd > 10 high, FALSE late, length, round(mean_fd, 7) mean_fd, round(max_fd, 7) max_fd, n_high FROM k JOIN s ON s.session_id = k.session_id
"""


def job2_cohort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch.folder(spark, "job2")
    for _ in range(2):
        found = cohort_table.run(spark, f"{sf_dir}/conversations.parquet", f"{place}/out")
    return found.select("site", "subject", *[F.round(f"meanFD_{v}", 9).alias(f"meanfd_{v.lower()}") for v in ("V1", "V2")], F.col("length_V1").alias("length_v1"), F.col("length_V2").alias("length_v2"), F.round("agg", 9).alias("agg"), "is_out")


JOB2 = r"""
WITH r AS (
  SELECT conv_id subject, 'site' || (conv_id % 4) site, CASE role WHEN 'user' THEN 'V1' WHEN 'assistant' THEN 'V2' END visit,
    [CAST(length(w) AS DOUBLE) FOR w IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF w <> ''] y
  FROM conversations WHERE conv_id IS NOT NULL)
, m AS (
  SELECT site, subject, visit, list_sum([abs(y[i + 1] - y[i]) FOR i IN generate_series(1, len(y) - 1)]) moved, greatest(len(y) - 1, 0) steps, len(y) frames FROM r WHERE visit IS NOT NULL)
, v AS (SELECT site, subject, visit, sum(moved) / nullif(sum(steps), 0) fd, sum(frames) FILTER (frames > 0) n FROM m GROUP BY ALL)
, w AS (
  SELECT a.site, a.subject, a.fd f1, b.fd f2, a.n n1, b.n n2, (a.fd + b.fd) / 2 agg FROM v a JOIN v b ON a.subject = b.subject AND a.site = b.site AND a.visit = 'V1' AND b.visit = 'V2'
  WHERE a.fd IS NOT NULL AND b.fd IS NOT NULL)
, l AS (SELECT site, quantile_cont(agg, 0.95) top FROM w GROUP BY site)
SELECT w.site, subject, round(f1, 9) meanfd_v1, round(f2, 9) meanfd_v2, CAST(n1 AS BIGINT) length_v1, CAST(n2 AS BIGINT) length_v2, round(agg, 9) agg, agg > top is_out FROM w JOIN l ON l.site = w.site
"""

QUERIES = {"job1_motion_stream": job1_motion_stream, "job2_cohort_table": job2_cohort_table}
ORACLES = {"job1_motion_stream": JOB1, "job2_cohort_table": JOB2}
