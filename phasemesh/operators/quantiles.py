"""Exact quantiles of groups of any size, without a buffer that holds a group's values.

A quantile lies between two neighbouring order statistics.  A double is turned into a whole number of 64 bits that is in the
same order.  For a group of more than ``whole`` values, rounds of counts by the leading bits of these numbers say which bin
holds a wanted rank; the next round counts the next 16 bits of the numbers in that bin alone, until a bin has few values or
one.  A round gives at most 65,536 counts for each bin, made where the values are.  Smaller groups are sorted as one array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..scratch import Scratch

#: Values of a group that are sorted as one array (800 kB), and the bits of a round.
WHOLE, BITS = 100_000, 16
#: Keys of groups or bins that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000


@F.pandas_udf(LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """Whole numbers in the order of doubles, NaN last."""
    v = x.to_numpy(np.float64) + 0.0  # -0 and 0 are one value
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


#: The number of NaN, which pandas would take for a missing value.
_NAN = 0x7FF8000000000000


@F.pandas_udf(DoubleType())
def _value(k: pd.Series) -> pd.Series:
    v = k.to_numpy(np.int64)
    return pd.Series(np.where(v < 0, v ^ np.int64(0x7FFFFFFFFFFFFFFF), v).view(np.float64))


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (counted, so a saved table) to be joined by broadcast if there are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def quantiles(df: DataFrame, by: Sequence[str], column: str, levels: Sequence[float], whole: int = WHOLE, bits: int = BITS) -> DataFrame:
    """``by..., n, mean, q``: number and mean of the values of each group, and their interpolated quantiles at ``levels``.

    The same as ``percentile``: the position of a level is its share of n - 1.  Nulls are left out, NaN counts as the greatest
    value, a group of nulls alone has no row, a null in ``by`` is a group; without ``by`` all rows are one group.
    """
    if not levels or not all(0 <= p <= 1 for p in levels):
        raise ValueError("levels lie between 0 and 1")
    names = [f"_g{i}" for i in range(len(by))]
    key = F.struct(*names) if by else F.struct(F.lit(0).alias("_g0"))
    plain = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(column).cast("double").alias("x")).where("x is not null")
    with Scratch(df.sparkSession, "quantiles") as tmp:
        values = tmp.save(plain.select(key.alias("g"), "x"), "values")
        sizes = tmp.save(values.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "sizes")
        large = sizes.where(F.col("n") > whole)
        if large.isEmpty():
            found = _sorted(values, levels)
        else:
            ids = few(large.select("g"))
            found = _sorted(values.join(ids, "g", "left_anti"), levels)
            found = found.unionByName(_rounds(tmp, values.join(ids, "g", "left_semi"), large, levels, whole, bits))
        return tmp.result(found.select(*[F.col(f"g.{n}").alias(c) for c, n in zip(by, names)], "n", "mean", "q"))


def _at(level: float, n: Column) -> tuple[Column, Column, Column]:
    """The ranks, from 0, on both sides of a level's position among n values, and how far it lies behind the first."""
    position = F.lit(float(level)) * (n - 1)
    low = F.floor(position)
    return low, F.ceil(position), position - low


def _mixed(low: Column, high: Column, share: Column) -> Column:
    return F.when(low.eqNullSafe(high), low).otherwise((F.lit(1.0) - share) * low + share * high)


def _sorted(values: DataFrame, levels: Sequence[float]) -> DataFrame:
    held = values.groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("l"), F.avg("x").alias("mean")).withColumn("n", F.size("l").cast("long"))
    ranks = [_at(p, F.col("n")) for p in levels]
    return held.select("g", "n", "mean", F.array(*[_mixed(F.get("l", a), F.get("l", b), share) for a, b, share in ranks]).alias("q"))


def _rounds(tmp: Scratch, values: DataFrame, sizes: DataFrame, levels: Sequence[float], whole: int, bits: int) -> DataFrame:
    """Quantiles of large groups.  ``targets``: every wanted rank with its bin (the leading bits so far) and how many values
    of its group lie below this bin.
    """
    values = tmp.save(values.select("g", _ordered("x").alias("k")), "numbers")
    ranks = F.array_distinct(F.array(*[r for p in levels for r in _at(p, F.col("n"))[:2]]))
    targets = sizes.select("g", F.explode(ranks).alias("r"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("below"))
    found: list[DataFrame] = []
    shift = 64
    while shift > 0:
        before, shift = shift, max(0, shift - bits)
        # a whole number has 64 bits: nothing is above them, and the first bins have their sign
        up = F.lit(0).cast("long") if before == 64 else F.shiftright("b", before - shift)
        counts = values.groupBy("g", F.shiftright("k", shift).alias("b")).agg(F.count("*").alias("n")).withColumn("bin", up)
        under = F.sum("n").over(Window.partitionBy("g", "bin").orderBy("b")) - F.col("n")
        counts = counts.withColumn("under", under)
        met = few(targets).join(counts, ["g", "bin"]).where("below + under <= r and r < below + under + n")
        met = tmp.save(met.select("g", "r", F.col("b").alias("bin"), (F.col("below") + F.col("under")).alias("below"), "n"), "targets")
        ended = met.where(F.col("n") <= whole) if shift else met
        if shift:
            held = values.withColumn("bin", F.shiftright("k", shift)).join(few(ended.select("g", "bin").distinct()), ["g", "bin"], "left_semi")
            held = held.groupBy("g", "bin").agg(F.sort_array(F.collect_list("k")).alias("l"))
            found.append(tmp.save(ended.join(held, ["g", "bin"]).select("g", "r", F.get("l", (F.col("r") - F.col("below"))).alias("k")), "found"))
            targets = met.where(F.col("n") > whole).drop("n")
            if targets.isEmpty():
                break
            values = values.withColumn("bin", F.shiftright("k", shift)).join(few(targets.select("g", "bin").distinct()), ["g", "bin"], "left_semi")
            values = tmp.save(values.select("g", "k"), "narrowed")
        else:
            found.append(ended.select("g", "r", F.col("bin").alias("k")))
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    by_rank = known.select("g", "r", F.when(F.col("k") == _NAN, float("nan")).otherwise(_value("k")).alias("x")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("m"))
    ranks = [_at(p, F.col("n")) for p in levels]
    return by_rank.join(sizes, "g").select("g", "n", "mean", F.array(*[_mixed(F.element_at("m", a), F.element_at("m", b), share) for a, b, share in ranks]).alias("q"))
