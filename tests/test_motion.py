"""Closed forms of head motion, and the failures the operators must make."""

import math

import pytest
from pyspark.sql import functions as F

from phasemesh.functions import keys
from phasemesh.operators import motion

MOTION = "session_id string, t int, p1 double, p2 double, p3 double, p4 double, p5 double, p6 double"


def frames(spark, *rows):
    return spark.createDataFrame([("s", t, *map(float, r)) for t, r in enumerate(rows)], MOTION)


def test_step_of_translation_and_rotation(spark):
    still = (0, 0, 0, 0, 0, 0)
    m = frames(spark, still, still, (1, 0, 0, 0, 0, 0), (1, 0, 0, 0.01, 0, 0), (1, 0, 0, 0.01, 0, 0))
    fd = {r.t: r.fd for r in motion.framewise_displacement(m).collect()}
    assert fd == pytest.approx({1: 0.0, 2: 1.0, 3: 0.5, 4: 0.0})
    s = motion.fd_summary(motion.framewise_displacement(m)).first()
    assert (s.mean_fd, s.length) == (pytest.approx(0.375), 5)


def test_translation_moves_all_voxels_alike_and_rotation_by_radius(spark):
    grid = spark.createDataFrame([("s", i, j, k) for i in range(4) for j in range(4) for k in range(4)], "session_id string, i int, j int, k int")
    m = frames(spark, (0,) * 6, (0, 3, 4, 0, 0, 0), (0, 3, 4, 0, 0, 0.1))
    eye = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
    rows = motion.voxel_displacement(grid, m, eye).collect()
    assert {round(r.fd, 12) for r in rows if r.t == 0} == {0.0}
    assert {round(r.fd, 12) for r in rows if r.t == 1} == {5.0}
    for r in rows:
        if r.t == 2:
            radius = math.hypot(r.i, r.j - 3)
            assert r.fd == pytest.approx(2 * radius * math.sin(0.05), abs=1e-12)


def test_region_mean_with_mask(spark):
    v = spark.createDataFrame([("s", 0, 0, 0, 0, 1.0), ("s", 1, 0, 0, 0, 3.0)], "session_id string, i int, j int, k int, t int, fd double")
    mask = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 0.0)], "i int, j int, k int, mask double")
    assert motion.region_mean(v).first().mean_fd == 2.0
    assert motion.region_mean(v, mask).first().mean_fd == 1.0
    both = motion.region_means(v, mask).first()
    assert (both.whole, both.region) == (2.0, 1.0)


def test_duplicate_pivot_key_fails(spark):
    df = spark.createDataFrame([(1, "V1", 2.0), (1, "V1", 3.0)], "id int, visit string, m double")
    with pytest.raises(Exception, match="duplicate key"):
        motion.pivot_unique(df, "id", "visit", ["V1"], "m").collect()


def test_length_check(spark):
    volume = spark.createDataFrame([("s", 0, 0, 0, [1.0, 2.0])], "session_id string, i int, j int, k int, y array<double>")
    good = frames(spark, (0,) * 6, (0,) * 6)
    assert motion.check_lengths(good, volume).count() == 2
    with pytest.raises(Exception, match="differ"):
        motion.check_lengths(frames(spark, (0,) * 6), volume).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (None,)], "x double")
    assert {r.bin: r.n for r in motion.histogram(df, "x", 1.0).collect()} == {0: 1, 1: 2, 2: 1}
    assert {r.bin: r.n for r in motion.histogram(df, "x", 1.0, True).collect()} == {-1: 1, 0: 1, 1: 2}


def test_session_names(spark):
    df = spark.createDataFrame([("ESO_C00012_20200101_1200_2",), ("other",)], "n string")
    rows = df.select(*[c.alias(k) for k, c in keys.session_fields("n").items()]).collect()
    assert tuple(rows[0]) == ("c", "C00012", 2)
    assert tuple(rows[1]) == (None, None, None)
    assert spark.range(1).select(keys.padded(F.lit(1234567)).alias("x"), keys.padded(F.lit(7)).alias("y")).first() == ("1234567", "00007")


def test_sessions_of_long_numbers(spark, tmp_path):
    """Numbers over 99999: all fields are there, names have five digits, and sets hold the whole numbers."""
    import duckdb

    from phasemesh.plans import catalog

    row = spark.createDataFrame([("ESO_P123456_20200101_1200_1",)], "n string").select(*[c.alias(k) for k, c in keys.session_fields("n").items()]).first()
    assert tuple(row) == ("p", "P123456", 1)
    numbers = [6, 12, 100128, 100130, 100132, 700002, 900000, 900001, 2700018]
    spark.createDataFrame([(n,) for n in numbers], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, 10 * n + k) for n in numbers for k in (1, 2)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("session_keys", "session_sets", "set_members"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(catalog.ORACLES[name])
        at = [df.columns.index(c[0]) for c in want.description]
        assert sorted(tuple(r[i] for i in at) for r in df.collect()) == sorted(want.fetchall()), name


def test_series_pick_and_missing_run(spark):
    df = spark.createDataFrame([("a, REST_run1  b",), ("c",)], "s string")
    v = {"rest": ["rest"]}
    assert [r.series_name for r in motion.pick_series(df, "s", v, "rest").collect()] == ["REST_run1", None]
    assert [r.series_name for r in motion.pick_series(df, "s", v, "task").collect()] == [None, None]


def test_tasks_of_voxels_hold_as_much_of_any_table(spark, tiny, same_as_sql, monkeypatch):
    """There is a task for each so many frames, and the voxels of all sessions are not broadcast to it."""
    from phasemesh.plans import inputs, motion_queries

    monkeypatch.setattr(inputs, "FRAMES", 100)
    rows = spark.read.parquet(f"{tiny}/lineitem.parquet").count()
    for name in ("roi_mean", "voxel_fd"):
        query, sql = motion_queries.QUERIES[name]
        df = query(spark, tiny)
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
        same_as_sql(query, sql)
    held = motion_queries._voxels(spark, tiny).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("session_id", "t").alias("n"))
    assert sum(r.n for r in held.collect()) == rows
    assert motion_queries._voxels(spark, tiny).rdd.getNumPartitions() == -(-rows // 100)
