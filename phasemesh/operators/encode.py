"""Values as colours and other tables for drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cplx


def palette_index(df: DataFrame, value: str, n: int = 256, low: float | None = None, high: float | None = None) -> DataFrame:
    """``colour``: 1..n over the value range (or a fixed one), half to even; null stays null (drawn grey)."""
    if low is None or high is None:
        ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        df = df.crossJoin(F.broadcast(ends))  # one row
    else:
        df = df.withColumn("_lo", F.lit(float(low))).withColumn("_hi", F.lit(float(high)))
    x = (n - 1) * (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) + 1
    return df.withColumn("colour", F.bround(x).cast("int")).drop("_lo", "_hi")


def p_class(p: Column) -> Column:
    """Number of usual significance levels that p is below: 0 to 4."""
    return sum((F.when(p < x, 1).otherwise(0) for x in (0.1, 0.05, 0.01, 0.001)), F.lit(0))


def p_colour(p: Column, table: list[tuple[float, str]], missing: str = "gray33", other: str = "white") -> Column:
    """Colour of the smallest threshold that p is below."""
    out = F.when(p.isNull() | F.isnan(p), F.lit(missing))
    for threshold, colour in sorted(table):
        out = out.when(p < threshold, F.lit(colour))
    return out.otherwise(F.lit(other))


def ranges(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def symmetric_range(df: DataFrame, value: str, *by: str) -> DataFrame:
    top = F.max(F.abs(F.col(value)))
    return df.groupBy(*by).agg((-top).alias("low"), top.alias("high"))


def time_courses(scores: DataFrame, fs: float) -> DataFrame:
    return scores.select("session_id", "t", "pc", (F.col("t") / float(fs)).alias("seconds"), cplx.mod().alias("mod"), cplx.arg().alias("arg"))


def difference_maps(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Signed square root of the difference of moduli, and the wrapped difference of phases, of ``a`` less ``b``."""
    left = a.select(*key, cplx.mod().alias("ma"), cplx.arg().alias("pa"))
    right = b.select(*key, cplx.mod().alias("mb"), cplx.arg().alias("pb"))
    return left.join(right, list(key)).select(*key, cplx.signed_sqrt(F.col("ma") - F.col("mb")).alias("d_mod"), cplx.wrap(F.col("pa") - F.col("pb")).alias("d_arg"))


def beta_maps(betas: DataFrame, group: str) -> DataFrame:
    """Group averages of complex betas by vertex and component, their difference (group 0 less 1), and root moduli."""
    part = {(c, g): F.avg(F.when(F.col(group) == g, F.col(c))) for c in ("re", "im") for g in (0, 1)}
    m = betas.groupBy("vertex", "pc").agg(*[v.alias(f"{c}{g}") for (c, g), v in part.items()])
    d = (F.col("re0") - F.col("re1"), F.col("im0") - F.col("im1"))
    return m.select("vertex", "pc", *[F.sqrt(cplx.mod(f"re{g}", f"im{g}")).alias(f"root_mod{g}") for g in (0, 1)], F.sqrt(cplx.mod(*d)).alias("root_mod_diff"))


def overlay(group: DataFrame, single: DataFrame, fs_group: float, fs_single: float) -> DataFrame:
    """Group and single-session courses on one axis of seconds."""
    a = group.select("session_id", "pc", (F.col("t") / float(fs_group)).alias("seconds"), "re", "im", F.lit("group").alias("kind"))
    b = single.select("session_id", "pc", (F.col("t") / float(fs_single)).alias("seconds"), "re", "im", F.lit("single").alias("kind"))
    return a.unionByName(b)
