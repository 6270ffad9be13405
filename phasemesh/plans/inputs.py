"""The star-schema tables read as the data model: motion, complex matrices, visits, meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VARIABLES = 32
#: Frames of a task where sessions are dealt by their number (:func:`motion`).
FRAMES = 200_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def motion(spark: SparkSession, d: str, kind: str | None = None, frames: int | None = None) -> DataFrame:
    """Six parameters by supplier, frames in order of shipping.  With ``kind`` the session is of this type, and rows are
    shuffled by it, so that later groups need no shuffle of their own.  With ``frames`` there are as many tasks as give each
    about this number of them, so that what a task holds does not grow with the table.
    """
    lines, key = table(spark, d, "lineitem"), "l_suppkey"
    if kind:
        lines, key = lines.withColumn("session_id", F.col(key).cast(kind)), "session_id"
    if frames:
        lines = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // frames)), key)
    order = Window.partitionBy(key).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.select(
        F.col(key).alias("session_id"),
        F.row_number().over(order).cast("long").alias("t"),
        F.col("l_quantity").alias("p1"),
        (F.col("l_extendedprice") / 1000).alias("p2"),
        F.col("l_linenumber").cast("double").alias("p3"),
        F.col("l_discount").alias("p4"),
        F.col("l_tax").alias("p5"),
        (F.col("l_discount") * F.col("l_tax")).alias("p6"),
    )


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of arrays: the first half of an embedding is real, the second imaginary."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("session_id"), F.col("vec_id").alias("t"), F.slice(e, 1, VARIABLES).alias("re"), F.slice(e, VARIABLES + 1, VARIABLES).alias("im")
    )


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Long form ``session_id, t, v, re, im``."""
    from ..operators.complex_stats import explode_obs

    return explode_obs(obs(spark, d)).withColumn("session_id", F.col("session_id").cast("int"))


def weights(spark: SparkSession, n: int = 3) -> DataFrame:
    """Fixed loadings ``v, pc, wr, wi``."""
    v = spark.range(VARIABLES).select(F.col("id").cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pc"))
    return v.select("v", "pc", (F.cos((F.col("v") * (F.col("pc") + 1)).cast("double")) / 6).alias("wr"), (F.sin((F.col("v") + 2 * F.col("pc")).cast("double")) / 6).alias("wi"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Values of subjects at two visits: before and after the middle of the month."""
    return table(spark, d, "events").select(
        "event_id", "user_id", "ts", "event_type", "value", (F.col("user_id") % 2).cast("long").alias("g"), F.when(F.dayofmonth("ts") <= 15, "V1").otherwise("V2").alias("visit")
    )


def faces(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of an order, a part and a supplier, with the quantity."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b"), (F.col("l_suppkey") + 2_000_000).alias("c"), "l_quantity")


#: What group 1 has more than group 0 at some vertices of :func:`surface`.
PLANTED = "0.06 * g * CAST(CASE WHEN vertex < 24 AND vertex % 8 BETWEEN 2 AND 4 THEN 1 WHEN vertex >= 40 AND vertex % 8 BETWEEN 5 AND 6 THEN -1 ELSE 0 END AS DOUBLE)"


def surface(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Values of sessions at the 64 vertices of two hemispheres (``hemi, vertex, subject, g, value``: one component of an
    embedding each, several embeddings to a subject, named by text), and the triangles of two grids of 4 x 8 vertices.
    Embeddings do not differ between labels, so a difference is planted at 9 vertices of one grid and 6 of the other.
    """
    e = table(spark, d, "embeddings").where("label is not null")
    hemi = F.when(F.col("vertex") < 32, "lh").otherwise("rh")
    x = e.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("vertex", "value"))
    x = x.select(hemi.alias("hemi"), "vertex", F.concat(F.lit("s"), "label", F.lit(":"), F.col("vec_id") % 7).alias("subject"), (F.col("label") % 2).cast("int").alias("g"), "value")
    x = x.withColumn("value", F.col("value") + F.expr(PLANTED))
    v = spark.range(64).select(F.col("id").cast("int").alias("vertex")).where("vertex % 8 < 7 and vertex % 32 < 24")
    two = F.array(F.expr("struct(vertex AS a, vertex + 1 AS b, vertex + 8 AS c)"), F.expr("struct(vertex + 1 AS a, vertex + 9 AS b, vertex + 8 AS c)"))
    return x, v.select(hemi.alias("hemi"), F.explode(two).alias("f")).select("hemi", "f.a", "f.b", "f.c")


#: The same in DuckDB, as common table expressions.
RP = """rp AS (SELECT l_suppkey s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) t,
  l_quantity p1, l_extendedprice / 1000 p2, CAST(l_linenumber AS DOUBLE) p3, l_discount p4, l_tax p5, l_discount * l_tax p6 FROM lineitem)"""
FD = RP + """, fd AS (SELECT s, t, abs(p1 - lag(p1) OVER w) + abs(p2 - lag(p2) OVER w) + abs(p3 - lag(p3) OVER w)
  + 50 * (abs(p4 - lag(p4) OVER w) + abs(p5 - lag(p5) OVER w) + abs(p6 - lag(p6) OVER w)) fd FROM rp WINDOW w AS (PARTITION BY s ORDER BY t))"""
CELLS = """c AS (SELECT label ds, vec_id t, CAST(p AS INTEGER) v, CAST(embedding[p + 1] AS DOUBLE) re, CAST(embedding[p + 33] AS DOUBLE) im
  FROM (SELECT label, vec_id, embedding, unnest(generate_series(0, 31)) p FROM embeddings))"""
WEIGHTS = """w AS (SELECT CAST(v AS INTEGER) v, CAST(pc AS INTEGER) pc, cos(CAST(v * (pc + 1) AS DOUBLE)) / 6 wr, sin(CAST(v + 2 * pc AS DOUBLE)) / 6 wi
  FROM (SELECT unnest(generate_series(0, 31)) v) a, (SELECT unnest(generate_series(0, 2)) pc) b)"""
EVENTS = """e AS (SELECT event_id, user_id, ts, event_type, value, CAST(user_id % 2 AS BIGINT) g, CASE WHEN day(ts) <= 15 THEN 'V1' ELSE 'V2' END visit FROM events)"""
FACES = """f AS (SELECT l_orderkey a, l_partkey + 1000000 b, l_suppkey + 2000000 c, l_quantity FROM lineitem)"""
SURFACE = f"""x AS (SELECT subject, g, vertex, val + {PLANTED} val FROM (SELECT 's' || label || ':' || (vec_id % 7) subject, CAST(label % 2 AS INTEGER) g, CAST(p AS INTEGER) vertex, CAST(embedding[p + 1] AS DOUBLE) val
  FROM (SELECT vec_id, label, embedding, unnest(generate_series(0, 63)) p FROM embeddings WHERE label IS NOT NULL)))
, v AS (SELECT CAST(unnest(generate_series(0, 63)) AS INTEGER) v)
, h AS (SELECT v src, v + 1 dst FROM v WHERE v % 8 < 7 UNION SELECT v, v + 8 FROM v WHERE v % 32 < 24 UNION SELECT v + 1, v + 8 FROM v WHERE v % 8 < 7 AND v % 32 < 24)
, n AS (SELECT src, dst FROM h UNION SELECT dst, src FROM h)"""
SCORES = CELLS + ", " + WEIGHTS + ", z AS (SELECT ds, t, pc, sum(re * wr - im * wi) re, sum(re * wi + im * wr) im FROM c JOIN w USING (v) GROUP BY ds, t, pc)"
