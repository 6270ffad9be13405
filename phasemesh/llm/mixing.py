"""Mixing sources to target weights by Poisson replication, in DataFrame expressions.

A source's mean repetition rate is its target share of the budget over its size.  Each document draws its number of
copies by inverting that Poisson distribution at a number hashed from the seed and its doc_id, so the draw needs no
shuffle, is the same on every run, and is independent of the order of rows.  The copies are then sorted globally by
another hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, delete_result

#: Rates above this are drawn as sums of independent parts, so that no table of the distribution grows.
PART = 32.0
#: So many sources may be broadcast with their tables (about 1 kB each); more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``source, rate``: mean repetitions of each source's documents.

    ``weights``: target shares by source (others get none); without it a source's share is its size to the power
    ``alpha``.  Sizes are code points of texts; the budget is ``epochs`` times all of them.  Null is a source of its
    own; a source without text gets rate 0.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    if weights is None:
        share = F.pow("size", F.lit(float(alpha)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        asked = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, w double")
        sizes = sizes.join(asked, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
        share = F.coalesce("w", F.lit(0.0))
    with Scratch(spark, "rates") as tmp:
        shared = tmp.save(sizes.select("source", "size", F.when(F.col("size") > 0, share).otherwise(0.0).alias("share")), "sources")
        total = shared.agg(F.sum("size").alias("all_size"), F.sum("share").alias("all_share"))
        rate = F.lit(float(epochs)) * F.col("all_size") * F.col("share") / F.col("all_share") / F.col("size")
        rate = F.when((F.col("size") > 0) & (F.col("all_share") > 0), rate).otherwise(0.0)
        return tmp.result(shared.join(F.broadcast(total)).select("source", rate.alias("rate")))  # one row


def uniform(*parts) -> Column:
    """A number in (0, 1) from the first 48 bits of an md5 hash."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until it is 1 in double precision."""
    top = F.ceil(rate + 12 * F.sqrt(rate + 1) + 12).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["all"])


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and source among them) once for each copy, in shuffled order, with ``part``,
    ``copy`` and ``shuffle_key``.

    Rows that repeat a doc_id draw alike and are each copied; null doc_ids draw as one id; a document that draws no
    copies is gone; an empty table gives no rows.  Columns named ``part``, ``copy`` or ``shuffle_key`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("part", "copy", "shuffle_key")]
    at = {n: f"c{docs.columns.index(n)}" for n in ("doc_id", "text", "source")}
    held = [f"c{i}" for i, c in enumerate(docs.columns) if c in names]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*held)
    made = rates(plain.select(F.col(at["text"]).alias("text"), F.col(at["source"]).alias("source")), weights, alpha, epochs)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    drawn_from = made.withColumn("parts", parts).select("source", "parts", _cumulative(F.col("rate") / parts).alias("_cdf"))
    if made.count() <= BROADCAST_SOURCES:
        right = F.broadcast(docs.sparkSession.createDataFrame(drawn_from.collect(), drawn_from.schema))
        delete_result(made)
    else:  # the table of rates stays, as the copies' plan reads it
        right = drawn_from
    met = plain.join(right, plain[at["source"]].eqNullSafe(right["source"]), "left")
    cut = met.select(*held, "_cdf", F.explode(F.sequence(F.lit(1), F.coalesce("parts", F.lit(1)))).alias("part"))
    u = uniform(seed, F.col(at["doc_id"]), F.col("part"))
    drawn = cut.select(*held, "_cdf", "part", u.alias("_u")).select(*held, "part", F.expr("size(filter(_cdf, c -> c < _u))").alias("_n"))
    copies = drawn.where("_n > 0").select(*held, "part", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    name = F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("null"))
    key = F.md5(F.concat_ws(":", F.lit(f"shuffle:{seed}"), name, F.col("part"), F.col("copy")))
    return copies.withColumn("shuffle_key", key).orderBy("shuffle_key", at["doc_id"]).toDF(*names, "part", "copy", "shuffle_key")
