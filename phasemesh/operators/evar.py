"""Explained variance across runs, sessions and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def best_run(r2: DataFrame) -> DataFrame:
    """``pc, run, r2``: the run that explains most for each component (ties: smallest run)."""
    best = r2.groupBy("pc").agg(F.max_by(F.struct("run", "r2"), F.struct(F.col("r2"), (-F.col("run")).alias("n"))).alias("b"))
    return best.select("pc", F.col("b.run").alias("run"), F.col("b.r2").alias("r2"))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The mode (ties: smallest value), as one row."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)


def best_so_far(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(w))


def scree(df: DataFrame, value: str = "sdev", *by: str) -> DataFrame:
    sq = F.col(value) * F.col(value)
    return df.withColumn("share", sq / F.sum(sq).over(Window.partitionBy(*by)))


def dominated(r2_wide: DataFrame, first: str, others: list[str]) -> Column:
    """Whether any later component explains more than the first."""
    return F.greatest(*[F.col(o) for o in others], F.lit(float("-inf"))) > F.col(first)


def share_over(df: DataFrame, value: str, limits: list[float], *by: str) -> DataFrame:
    """Counts and shares of values over each limit."""
    out = []
    for x in limits:
        name = f"{x:g}".replace("0.", "")
        out += [F.count_if(F.col(value) > x).alias(f"n_{name}"), F.avg((F.col(value) > x).cast("double")).alias(f"share_{name}")]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def box(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Minimum, quartiles and maximum; a group without values has no row."""
    found = quantiles(df, by, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    return found.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def retest(df: DataFrame, first: str, second: str, group: str) -> DataFrame:
    """Correlation between visits over all (null group) and by group, in one pass of grouping sets."""
    return df.groupingSets([[], [F.col(group)]], F.col(group)).agg(F.corr(first, second).alias("rho"), F.count("*").alias("n"))


def pair_visits(df: DataFrame, subject: str, visit: str, value: str, first, second) -> DataFrame:
    """Values of two visits side by side by subject; subjects with one visit are dropped."""
    a = df.where(F.col(visit) == first).select(subject, F.col(value).alias("v1"))
    b = df.where(F.col(visit) == second).select(subject, F.col(value).alias("v2"))
    return a.join(b, subject)


def renormalised_slice(rotation: DataFrame, *by: str) -> DataFrame:
    """Loadings ``(session, t, pc, wr, wi)`` cut by session and brought to unit length there."""
    norm = F.sqrt(F.sum(F.expr("wr * wr + wi * wi")).over(Window.partitionBy(*by, "pc")))
    return rotation.withColumn("_n", norm).withColumn("wr", F.col("wr") / F.col("_n")).withColumn("wi", F.col("wi") / F.col("_n")).drop("_n")
