"""The jobs: their queries against SQL, runs over growing input, odd rows, the command line."""

import glob
import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import cohort_table, common, motion_stream, queries
from phasemesh.operators import motion

FIELDS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_queries_equal_sql(same_as_sql):
    for name in queries.QUERIES:
        same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def expected(spark, frames):
    """Displacements of frames ``(session, t, value)`` in one go, by the batch operator."""
    said = common.config(spark, None, "motion_stream")
    df = frames.where(said["where"]).select(F.expr(said["session"]).alias("session_id"), F.col("event_id").alias("t"), *[F.expr(e).cast("double").alias(p) for p, e in zip(motion.PARAMS, said["parameters"])])
    return {(r.session_id, r.t): r.fd for r in motion.framewise_displacement(df).collect()}


def found(df):
    rows = [((r.session_id, r.t), r.fd) for r in df.where("not late").collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def same(got, want):
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def add(df, folder, name, tmp_path):
    """One more file in the folder, later than the others."""
    made = tmp_path / f"made-{name}"
    df.coalesce(1).write.parquet(str(made))
    (file,) = glob.glob(f"{made}/*.parquet")
    os.makedirs(folder, exist_ok=True)
    shutil.copy(file, f"{folder}/{name}.parquet")


def test_growing_input(spark, tiny, tmp_path):
    """Three runs over a folder that grows: only new files are read, sessions go on where they ended, late frames are kept."""
    events = spark.read.parquet(f"{tiny}/events.parquet")
    low, high = events.approxQuantile("event_id", [0.4, 0.8], 0)
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    add(events.where(F.col("event_id") <= low), source, "a", tmp_path)
    first = found(motion_stream.run(spark, source, out, state))
    same(first, expected(spark, events.where(F.col("event_id") <= low)))
    old = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/displacement/**/*.parquet", recursive=True)}
    add(events.where((F.col("event_id") > low) & (F.col("event_id") <= high)), source, "b", tmp_path)
    motion_stream.run(spark, source, out, state)
    add(events.where(F.col("event_id") > high), source, "c", tmp_path)
    late = events.orderBy("event_id").limit(3)
    add(late.withColumn("value", F.lit(99.0)), source, "d", tmp_path)
    for _ in range(2):  # the second has nothing to do
        last = motion_stream.run(spark, source, out, state)
        same(found(last), expected(spark, events))
        assert sorted(r.t for r in last.where("late").collect()) == sorted(r.event_id for r in late.collect())
        assert last.where("late and fd is not null").isEmpty()
    assert {f: os.stat(f).st_mtime_ns for f in old} == old
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    sums = {r.session_id: r for r in motion_stream.sessions(spark, out).collect()}
    whole = {}
    for (s, _), v in expected(spark, events).items():
        whole.setdefault(s, []).append(v)
    for s, v in whole.items():
        assert (sums[s].length, sums[s].high) == (len(v) + 1, sum(x > 10 for x in v)) and sums[s].mean_fd == pytest.approx(sum(v) / len(v)) and sums[s].max_fd == pytest.approx(max(v))
    assert sum(r.late for r in sums.values()) == 3


def test_a_batch_again_leaves_its_rows_once(spark, tiny, tmp_path):
    """A batch that is written a second time, as after a failure between its two tables."""
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("1", 1, 2.0, False), ("2", 5, 20.0, False), ("2", 6, None, True)], "session_id string, t long, fd double, late boolean")
    write = motion_stream._batch(out, common.config(spark, None, "motion_stream"))
    for batch in (0, 1, 1, 0):
        write(rows, batch)
    assert motion_stream.displacement(spark, out).count() == 6
    assert sorted((r.session_id, r.length, r.high, r.late) for r in motion_stream.sessions(spark, out).collect()) == [("1", 3, 0, 0), ("2", 3, 2, 2)]


def test_stream_of_odd_rows(spark, tmp_path):
    """Nulls, repeated frames, an extra column with a clashing name, no rows at all."""
    rows = [(1, None, 7, None, 1.0, None), (2, None, 7, None, None, None), (3, None, None, None, 1.0, None), (4, None, 7, "x", 3.0, None), (4, None, 7, "x", 3.0, None)]
    df = spark.createDataFrame(rows, FIELDS).withColumn("ts", F.lit("2024-01-01 05:10:00").cast("timestamp")).withColumn("session_id", F.lit("odd"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = motion_stream.run(spark, f"{tmp_path}/in/", str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()
    assert sorted((r.session_id, r.t, r.late, r.fd is None) for r in got) == [("7", 4, False, False), ("7", 4, True, True)]
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert motion_stream.run(spark, str(tmp_path / "none"), str(tmp_path / "out2"), str(tmp_path / "checkpoint2")).count() == 0
    assert motion_stream.sessions(spark, str(tmp_path / "out2")).count() == 0


def test_cohort_of_odd_rows(spark, tmp_path):
    fields = "conv_id long, turn long, role string, text string, visit string"
    rows = [
        (4, 0, "user", "a bbb a", "x"), (4, 1, "assistant", "aa a", None), (4, 2, "user", " \n", None), (4, 3, "system", "a " * 9, None), (4, 4, "tool", "a b", None),
        (8, 0, "user", "one two", None), (8, 1, "assistant", "word", None), (12, 0, "user", None, None), (None, 0, "user", "a b", None),
        (5, 0, "user", "x yy", None), (5, 0, "user", "x yy", None), (5, None, "assistant", "a " * 50_000 + "bb", None),
    ]
    spark.createDataFrame(rows, fields).repartition(2).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        got = cohort_table.run(spark, str(tmp_path / "in"), out)
        assert sorted((r.site, r.subject, r.meanFD_V1, r.length_V1, r.meanFD_V2, r.length_V2, r.is_out) for r in got.collect()) == [("site0", 4, 2.0, 3, 1.0, 2, False), ("site1", 5, 1.0, 4, pytest.approx(1 / 50_000), 50_001, False)]
    missing = spark.read.parquet(f"{out}/missing").orderBy("subject").collect()
    assert [(r.site, r.subject, r.V1, r.V2) for r in missing] == [("site0", 8, True, False), ("site0", 12, False, False)]
    assert [(r.site, r.n, r.n_out, r.median) for r in spark.read.parquet(f"{out}/sites").orderBy("site").collect()] == [("site0", 1, 0, 1.5), ("site1", 1, 0, pytest.approx((1 + 1 / 50_000) / 2))]
    # a site that is gone from the input is gone from the output
    spark.createDataFrame(rows[:2], fields).write.parquet(str(tmp_path / "less"))
    assert [r.subject for r in cohort_table.run(spark, str(tmp_path / "less"), out).collect()] == [4]
    spark.createDataFrame([], fields).write.parquet(str(tmp_path / "none"))
    assert cohort_table.run(spark, str(tmp_path / "none"), out).count() == 0


def test_config_and_command_line(spark, tiny, tmp_path):
    """A config over the defaults, read by Spark; unknown names are refused; the jobs run as programs."""
    (tmp_path / "c.json").write_text(json.dumps({"level": 0.5}))
    assert common.config(spark, str(tmp_path / "c.json"), "cohort_table")["level"] == 0.5
    (tmp_path / "bad.json").write_text(json.dumps({"levels": 0.5}))
    with pytest.raises(ValueError):
        common.config(spark, str(tmp_path / "bad.json"), "cohort_table")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = str(tmp_path / "out")
    ran = subprocess.run([sys.executable, "jobs/cohort_table.py", f"{tiny}/conversations.parquet", out, "--config", str(tmp_path / "c.json"), "--master", "local[2]"], cwd=repo, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and "subjects with both visits" in ran.stderr, ran.stderr[-2000:]
    ran = subprocess.run([sys.executable, "jobs/motion_stream.py", f"{tiny}/events.parquet", f"{out}2", str(tmp_path / "checkpoint"), "--master", "local[2]"], cwd=repo, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and "new frames" in ran.stderr, ran.stderr[-2000:]
    assert motion_stream.displacement(spark, f"{out}2").count() > 0
    share = spark.read.parquet(f"{out}/table").agg(F.avg(F.col("is_out").cast("int"))).first()[0]
    assert 0.3 < share < 0.6
