"""Blocks, offsets, ranks and samples over ordered rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "row", parts: int | None = None, sums: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``name``: each row's number, from 0, in a total order; and for every ``sums[new] = column`` a column with
    the sum of this column over all rows before.

    Rows are dealt to ranges of the order and sorted within each; what is counted and summed in the ranges before is then
    added.  So no task sees all rows, and the driver one short row for each range.  Rows that the order does not tell apart
    are in the order of a hash of their plain columns.  Nulls come first; a null adds nothing to a sum.
    """
    spark, sums = df.sparkSession, dict(sums or {})
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    if plain := [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]:
        by.append(F.xxhash64(*plain))
    with Scratch(spark, "numbered") as tmp:
        # ids of rows ascend within a range and from one range to the next
        ranged = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(by)])
        keys = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(by))]
        ranged = ranged.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*[f"_o{i}" for i in range(len(by))])
        ranged = tmp.save(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged").withColumn("_range", F.shiftright("_id", 33))
        totals = ranged.groupBy("_range").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"s{i}") for i, c in enumerate(sums.values())]).orderBy("_range").collect()
        before, said = [0] * (1 + len(sums)), []
        for t in totals:
            said.append((t["_range"], *before))
            before = [b + t[1 + i] for i, b in enumerate(before)]
        kinds = [dict(ranged.dtypes)[c] for c in sums.values()]
        kinds = ["double" if k in ("double", "float") else "long" for k in kinds]
        fields = ", ".join(["_range long", "_n long", *[f"_s{i} {k}" for i, k in enumerate(kinds)]])
        said = [(r, n, *[float(v) if k == "double" else int(v) for v, k in zip(vs, kinds)]) for r, n, *vs in said]
        met = ranged.join(F.broadcast(spark.createDataFrame(said, fields)), "_range")  # one row a range
        out = met.withColumn(name, F.col("_n") + F.col("_id") - F.shiftleft("_range", 33))
        inside = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        for i, (new, c) in enumerate(sums.items()):
            out = out.withColumn(new, F.col(f"_s{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
        return tmp.result(out.select(*df.columns, name, *sums))


def ordered_means(df: DataFrame, by: Sequence[str], column: str, *order: str) -> DataFrame:
    """``by..., mean`` of the values that are not null, added one after the other in a stated order.

    A sum of doubles depends on the order of its terms, and ``avg`` adds in whatever order tasks end; here a mean is the
    same in each run, however the rows lie.  The running sum needs no array of a group's values.
    """
    rows = Window.partitionBy(*by).orderBy(*order, column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = df.where(F.col(column).isNotNull()).select(*by, F.sum(column).over(rows).alias("_sum"), F.count(column).over(rows).alias("_n"))
    return told.groupBy(*by).agg(F.max_by("_sum", "_n").alias("_sum"), F.max("_n").alias("_n")).select(*by, (F.col("_sum") / F.col("_n")).alias("mean"))


def offsets(sizes: DataFrame, order: str, size: str = "n") -> DataFrame:
    """Rows before each session in a stated order."""
    return numbered(sizes, [order], "_row", sums={"offset": size}).drop("_row").withColumn("offset", F.col("offset").cast("long"))


def overlapping_blocks(sizes: DataFrame, blocks: int, length: int, size: str = "n") -> DataFrame:
    """``block, first, last`` of a fixed number of evenly spaced, possibly overlapping blocks of ``length`` rows."""
    room = F.greatest(F.col(size) - length, F.lit(0))
    block = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = F.floor(room * F.col("block") / max(1, blocks - 1)).cast("long")
    return block.withColumn("first", first).withColumn("last", F.least(first + length, F.col(size)).cast("long") - 1)


def epoch_blocks(sizes: DataFrame, length: int, epochs: int, seed: int = 0, key: str = "session_id", size: str = "n") -> DataFrame:
    """``key, epoch, batch, block, first, last``: every session cut into contiguous blocks of ``length`` rows, dealt to
    batches anew each epoch by hash.  A batch has one block of every session that has blocks left, and in an epoch each
    block comes once.
    """
    block = sizes.where(F.col(size) > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    block = block.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) - 1) / length).cast("long"))))
    order = Window.partitionBy(key, "epoch").orderBy(hash_order(seed, F.col("epoch"), F.col(key), F.col("block")), "block")
    out = block.withColumn("batch", F.row_number().over(order)).withColumn("first", F.col("block") * length)
    return out.select(key, "epoch", "batch", "block", "first", (F.least(F.col("first") + length, F.col(size)) - 1).cast("long").alias("last"))


def disjoint_block(position: Column, length: int) -> Column:
    return F.floor(position / length).cast("long")


def hash_order(*parts) -> Column:
    """A fixed pseudo-random order: md5 of the parts, the same in any engine."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def block_ids(df: DataFrame, key: str, blocks: int, epoch: int) -> DataFrame:
    """Block 1..blocks of every row, dealt anew each epoch."""
    known = numbered(df, [hash_order(epoch, F.col(key)), key], "_row")
    return known.withColumn("block", ((F.col("_row") + 1) % blocks + 1).cast("long")).drop("_row")


def exact_sample(df: DataFrame, key: str, size: int, seed: int, *by: str) -> DataFrame:
    """Exactly ``size`` rows (of each group) without replacement, by hash order."""
    if not by:
        return df.withColumn("_h", hash_order(seed, F.col(key))).orderBy("_h", key).limit(size).drop("_h")
    w = Window.partitionBy(*by).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def average_rank(value: str, *by: str) -> Column:
    """Ranks with ties averaged."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(order).cast("double") + (F.count("*").over(ties).cast("double") - 1) / 2


def combinations(items: list, size: int, sample: int | None = None, seed: int = 0) -> list[tuple]:
    """Combinations of items, or distinct ones sampled by rank without listing all of them."""
    items = sorted(items)
    total = math.comb(len(items), size)
    if sample is None or sample >= total:
        return list(itertools.combinations(items, size))
    rng = np.random.default_rng(seed)
    ranks: set[int] = set()
    while len(ranks) < sample:
        ranks.add(int(rng.integers(total)))
    return [_unrank(items, size, r) for r in sorted(ranks)]


def _unrank(items: list, size: int, rank: int) -> tuple:
    out, start = [], 0
    for left in range(size, 0, -1):
        for i in range(start, len(items)):
            n = math.comb(len(items) - i - 1, left - 1)
            if rank < n:
                out.append(items[i])
                start = i + 1
                break
            rank -= n
    return tuple(out)


def mirror_pad(y: str, n: int, with_edge: bool) -> Column:
    """An array with ``n`` mirrored values at either end, with or without repeating the edge."""
    c = F.col(y)
    size = F.size(c)
    if with_edge:
        head, tail = F.slice(c, F.lit(1), F.lit(n)), F.slice(c, size - n + 1, F.lit(n))
    else:
        head, tail = F.slice(c, F.lit(2), F.lit(n)), F.slice(c, size - n, F.lit(n))
    return F.concat(F.reverse(head), c, F.reverse(tail))


def resample_linear(y: str, fs: float, fs_new: float) -> Column:
    """Linear interpolation of an array from rate ``fs`` to ``fs_new``; points past the last sample are null."""
    c = F.col(y)
    n_new = F.floor(F.size(c) * (fs_new / fs)).cast("int")
    ratio = fs / fs_new

    def at(i: Column) -> Column:
        x = i * ratio
        lo = F.floor(x).cast("int")
        a, b = F.get(c, lo), F.get(c, lo + 1)
        return F.when(x == lo, a).otherwise(a + (b - a) * (x - lo))

    return F.transform(F.sequence(F.lit(0), n_new - 1), at)
