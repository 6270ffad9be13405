"""Exact quantiles against Spark's own on random groups with ties, through every way of finding them."""

import random

import pytest
from pyspark.sql import functions as F

from phasemesh.operators.quantiles import quantiles

LEVELS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]


def rows():
    rng = random.Random(3)
    made = [(g, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-300), rng.gauss(0, 1e300), 1.0, 0.0, -0.0, float(rng.randrange(5)), None])) for g in ("a", "b", None) for _ in range(400)]
    made += [("one", 7.5), ("two", 1.0), ("two", 2.0), ("nulls", None), ("same", 3.0)] + [("same", 3.0)] * 200
    made += [("inf", x) for x in (float("inf"), float("-inf"), 1.0, 2.0)] + [("nan", x) for x in (1.0, float("nan"), 2.0, float("nan"))]
    return made


@pytest.mark.parametrize("whole, bits", [(100_000, 16), (1, 16), (30, 4), (0, 11), (3, 63)])
def test_as_percentile(spark, whole, bits):
    df = spark.createDataFrame(rows(), "g string, v double").repartition(5)
    got = {r.g: (r.n, r.q) for r in quantiles(df, ["g"], "v", LEVELS, whole, bits).collect()}
    want = {r.g: (r.n, r.q) for r in df.where("v is not null").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.lit(LEVELS)).alias("q")).collect()}
    assert got.keys() == want.keys()
    for g, (n, q) in want.items():
        assert got[g][0] == n
        for a, b in zip(got[g][1], q):
            assert (a != a and b != b) or a == pytest.approx(b, rel=1e-12, abs=0), (g, got[g], q)


def test_one_group_and_none(spark):
    df = spark.range(1001).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    for whole in (100_000, 10):
        assert [tuple(r) for r in quantiles(df, [], "v", [0.5, 0.95], whole).collect()] == [(1001, 500.0, [500.0, 950.0])]
        assert quantiles(df.limit(0), [], "v", [0.5], whole).collect() == [] == quantiles(df.limit(0), ["g"], "v", [0.5], whole).collect()
    with pytest.raises(ValueError):
        quantiles(df, [], "v", [1.5])
