"""Row numbers and running sums over ranges of an order."""

import random

import pytest
from pyspark.sql import functions as F

from phasemesh.operators import ordered


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_and_sums(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), i, rng.choice([None, 1, 2, 5]), rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, i int, n int, x double").repartition(5)
    got = sorted(ordered.numbered(df, ["k", F.col("i") * -1], "row", parts, {"n_before": "n", "x_before": "x"}).collect(), key=lambda r: r.row)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [(r.k, r.i) for r in got] == [r[:2] for r in want] and [r.row for r in got] == list(range(700))
    n, x = 0, 0.0
    for r, w in zip(got, want):
        assert r.n_before == n and r.x_before == pytest.approx(x, abs=1e-9)
        n, x = n + (w[2] or 0), x + w[3]


def test_one_value_and_no_rows(spark):
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert sorted(r.row for r in ordered.numbered(same, ["k"], parts=4).collect()) == list(range(500))
    assert ordered.numbered(same.limit(0), ["k"]).collect() == []


def test_no_task_sees_all_rows(spark):
    plan = ordered.block_ids(spark.range(100), "id", 10, 1)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    sizes = spark.range(50).select("id", F.lit(3).alias("n"))
    assert "SinglePartition" not in ordered.offsets(sizes, "id")._jdf.queryExecution().toString()
    assert [r.offset for r in ordered.offsets(sizes, "id").orderBy("id").collect()] == [3 * i for i in range(50)]
