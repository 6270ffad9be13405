"""Queries on complex matrices: statistics, explained variance, blocks and drawing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cplx
from ..operators import complex_stats as cs
from ..operators import encode, evar, ordered
from . import inputs
from .inputs import CELLS, EVENTS, SCORES, WEIGHTS


def _r(c, n: int):
    return F.round(c, n) + 0.0  # no negative zero


def complex_var(spark: SparkSession, d: str) -> DataFrame:
    s = cs.column_stats(inputs.cells(spark, d))
    return s.select("v", *[_r(F.col(c), 8).alias(c) for c in ("mean_re", "mean_im", "var")])


def total_variance(spark: SparkSession, d: str) -> DataFrame:
    return cs.total_variance(cs.column_stats(inputs.cells(spark, d))).select(_r(F.col("total_var"), 8).alias("total_var"))


def center_scale(spark: SparkSession, d: str) -> DataFrame:
    x = cs.center_scale(inputs.cells(spark, d))
    return x.select("t", "v", _r(F.col("re"), 7).alias("re"), _r(F.col("im"), 7).alias("im"))


def const_cols(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by order priority and month that never change: constant in every session, and what is left."""
    o = inputs.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("session_id"), F.monotonically_increasing_id().alias("t"), (F.col("l_partkey") % 50).cast("int").alias("v"), F.col("l_quantity").alias("q"))
    x = o.select("session_id", "t", "v", F.when(F.col("v") % 7 == 0, 1.0).otherwise(F.col("q")).alias("re"), F.lit(0.0).alias("im"))
    c = cs.constant_columns(x)
    left = cs.drop_constant(x).groupBy("v").agg(F.count("*").alias("n_left"))
    return c.join(left, "v", "full").select("v", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), F.coalesce("n_left", F.lit(0)).alias("n_left"))


def magnitudes(spark: SparkSession, d: str) -> DataFrame:
    m = cs.magnitudes(inputs.cells(spark, d), "session_id")
    return m.select(F.col("session_id").alias("ds"), *[_r(F.col(c), 8).alias(c) for c in m.columns[1:]])


def magnitude_medians(spark: SparkSession, d: str) -> DataFrame:
    m = cs.magnitude_medians(inputs.cells(spark, d), "session_id")
    return m.select(F.col("session_id").alias("ds"), *[_r(F.col(c), 8).alias(c) for c in m.columns[1:]])


def gram(spark: SparkSession, d: str) -> DataFrame:
    return cs.gram(inputs.cells(spark, d)).select("i", "j", _r(F.col("re"), 7).alias("re"), _r(F.col("im"), 7).alias("im"))


def mod_arg(spark: SparkSession, d: str) -> DataFrame:
    g = inputs.cells(spark, d).groupBy("v").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    re, im = cplx.mul(("re", "im"), cplx.conj(("re", "im")))
    return g.select("v", _r(cplx.mod(), 8).alias("mod"), _r(cplx.arg(), 7).alias("arg"), _r(F.sqrt(re), 8).alias("mod2"), _r(im, 8).alias("zero"))


def wrap_phase(spark: SparkSession, d: str) -> DataFrame:
    return inputs.events(spark, d).select("event_id", _r(cplx.wrap(F.col("value")), 7).alias("wrapped"))


def adjust_phase(spark: SparkSession, d: str) -> DataFrame:
    x = inputs.cells(spark, d).select("session_id", "t", "v", cplx.arg().alias("phase"))
    a = cs.adjust_phase(x, "phase", "v", steps=48)
    return a.groupBy("v", "step").agg(F.count("*").alias("n"), _r(F.min("adjusted"), 6).alias("low"), _r(F.max("adjusted"), 6).alias("high"))


def scatter_full(spark: SparkSession, d: str) -> DataFrame:
    means = inputs.table(spark, d, "lineitem").where("l_quantity > 45 and l_discount > 0.05").groupBy(F.col("l_partkey").alias("vertex")).agg(_r(F.avg("l_extendedprice"), 7).alias("value"))
    return cs.scatter_full(means, inputs.table(spark, d, "part").select(F.col("p_partkey").alias("vertex")), "vertex")


def cortex_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of signal at labelled vertices only."""
    atlas = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("vertex"), F.when(F.col("c_mktsegment") == "MACHINERY", "unknown").when(F.col("c_mktsegment") == "BUILDING", "corpuscallosum").otherwise(F.col("c_mktsegment")).alias("label"))
    o = inputs.table(spark, d, "orders").select(F.col("o_custkey").alias("vertex"), "o_totalprice")
    return o.join(cs.cortex(atlas), "vertex").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vertex").alias("n_vertices"))


def _scores(spark, d) -> DataFrame:
    z = cs.row_scores(inputs.obs(spark, d), inputs.weights(spark))
    return z.withColumn("session_id", F.col("session_id").cast("int"))


def fixed_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("t", "pc", _r(F.col("re"), 7).alias("re"), _r(F.col("im"), 7).alias("im"))


def group_ev(spark: SparkSession, d: str) -> DataFrame:
    return cs.explained(_scores(spark, d), inputs.cells(spark, d)).select("pc", _r(F.col("r2"), 8).alias("r2"))


def individual_ev(spark: SparkSession, d: str) -> DataFrame:
    e = cs.explained(_scores(spark, d), inputs.cells(spark, d), "session_id")
    return e.select(F.col("session_id").alias("ds"), "pc", _r(F.col("r2"), 8).alias("r2"))


def fit_ev(spark: SparkSession, d: str) -> DataFrame:
    """Shares explained by session in cells centred and scaled as for a fit."""
    e = cs.explained_by(inputs.cells(spark, d), inputs.weights(spark), "session_id", standardize="fit")
    return e.select(F.col("session_id").alias("ds"), "pc", _r(F.col("r2"), 8).alias("r2"))


def slice_ev(spark: SparkSession, d: str) -> DataFrame:
    """Temporal loadings cut by session, brought to unit length, and the variance of the maps they give."""
    x = inputs.cells(spark, d)
    rot = x.select("session_id", "t").distinct().withColumn("pc", F.explode(F.array(F.lit(0), F.lit(1))))
    rot = rot.select("session_id", "t", "pc", F.cos((F.col("t") * (F.col("pc") + 1)).cast("double")).alias("wr"), F.sin((F.col("t") + F.col("pc")).cast("double")).alias("wi"))
    rot = evar.renormalised_slice(rot, "session_id")
    zr, zi = cplx.mul(("re", "im"), ("wr", "wi"))
    maps = x.join(rot, ["session_id", "t"]).groupBy("session_id", "pc", "v").agg(F.sum(zr).alias("re"), F.sum(zi).alias("im"))
    top = maps.groupBy("session_id", "pc").agg(cplx.variance().alias("a"))
    total = x.groupBy("session_id", "t").agg(cplx.variance().alias("s")).groupBy("session_id").agg(F.sum("s").alias("b"))
    return top.join(total, "session_id").select(F.col("session_id").alias("ds"), "pc", _r(F.col("a") / F.col("b"), 8).alias("r2"))


def posthoc_slope(spark: SparkSession, d: str) -> DataFrame:
    s = cs.posthoc_slope(inputs.cells(spark, d), _scores(spark, d))
    return s.select("v", "pc", _r(F.col("re"), 6).alias("re"), _r(F.col("im"), 6).alias("im"))


def mcc(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of each variable with the one before it."""
    x = inputs.cells(spark, d)
    a = x.select("session_id", "t", "v", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = x.select("session_id", "t", (F.col("v") + 1).alias("v"), F.col("re").alias("br"), F.col("im").alias("bi"))
    return cs.complex_correlation(a.join(b, ["session_id", "t", "v"]), "v").select("v", _r(F.col("mcc"), 7).alias("mcc"))


def mcc_share(spark: SparkSession, d: str) -> DataFrame:
    m = inputs.events(spark, d).select("g", (F.least(F.col("value"), F.lit(100.0)) / 100).alias("mcc"))
    return evar.share_over(m, "mcc", [0.95, 0.975], "g").select("g", "n_95", _r(F.col("share_95"), 9).alias("share_95"), "n_975", _r(F.col("share_975"), 9).alias("share_975"))


def cum_best(spark: SparkSession, d: str) -> DataFrame:
    return evar.best_so_far(inputs.events(spark, d), "value", "event_id", "user_id").select("event_id", "best")


def run_variance(spark: SparkSession, d: str) -> DataFrame:
    """Variance of a variable's score over experiments (sessions)."""
    means = inputs.cells(spark, d).groupBy("session_id", "v").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return means.groupBy("v").agg(_r(cplx.variance(), 9).alias("var"))


def _r2(spark, d) -> DataFrame:
    e = inputs.events(spark, d)
    return e.groupBy((F.col("user_id") % 3).cast("int").alias("run"), F.col("event_type").alias("pc")).agg(F.avg("value").alias("r2"))


def best_run(spark: SparkSession, d: str) -> DataFrame:
    best = evar.best_run(_r2(spark, d))
    mode = evar.most_frequent(best, "run").select(F.col("run").alias("mode_run"), F.col("n").alias("mode_n"))
    return best.crossJoin(F.broadcast(mode)).select("pc", "run", _r(F.col("r2"), 9).alias("r2"), "mode_run", "mode_n")  # one row


def scree_share(spark: SparkSession, d: str) -> DataFrame:
    return evar.scree(_r2(spark, d), "r2", "run").select("run", "pc", _r(F.col("share"), 8).alias("share"))


def dominance(spark: SparkSession, d: str) -> DataFrame:
    kinds = sorted(["click", "error", "login", "purchase", "view"])
    wide = inputs.table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.avg("value"))
    share = wide.withColumn("flag", evar.dominated(wide, kinds[0], kinds[1:]))
    return share.groupBy((F.col("user_id") % 2).cast("long").alias("g"), (F.col("user_id") % 3).cast("long").alias("visit")).agg(_r(F.avg(F.col("flag").cast("double")), 9).alias("share"), F.count("*").alias("n"))


def box_summary(spark: SparkSession, d: str) -> DataFrame:
    b = evar.box(inputs.events(spark, d), "value", "g", "visit")
    return b.select("g", "visit", *[_r(F.col(c), 9).alias(c) for c in b.columns[2:]])


def color_range(spark: SparkSession, d: str) -> DataFrame:
    e = inputs.events(spark, d)
    return encode.ranges(e, "value", "event_type").join(encode.symmetric_range(e.withColumn("value", F.col("value") - 50), "value", "event_type").select("event_type", F.col("high").alias("sym")), "event_type").select("event_type", "low", "high", _r(F.col("sym"), 9).alias("sym"))


def color_bin(spark: SparkSession, d: str) -> DataFrame:
    free = encode.palette_index(inputs.events(spark, d).select("event_id", "value"), "value", 256)
    return encode.palette_index(free.withColumnRenamed("colour", "free"), "value", 101, 0.0, 50.0).select("event_id", "free", F.col("colour").alias("fixed"))


def pval_color(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("value") / 200
    e = inputs.events(spark, d)
    table = [(0.1, "yellow"), (0.05, "orange"), (0.01, "red"), (0.001, "darkred")]
    missing = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(p)
    return e.select("event_id", encode.p_class(p).cast("int").alias("class"), encode.p_colour(missing, table).alias("colour"))


def time_courses(spark: SparkSession, d: str) -> DataFrame:
    t = encode.time_courses(_scores(spark, d), 2.0)
    return t.select("t", "pc", F.col("seconds"), _r(F.col("mod"), 7).alias("mod"), _r(F.col("arg"), 6).alias("arg"))


def difference_maps(spark: SparkSession, d: str) -> DataFrame:
    means = inputs.cells(spark, d).groupBy(F.col("session_id") % 2, "v").agg(F.avg("re").alias("re"), F.avg("im").alias("im")).toDF("side", "v", "re", "im")
    m = encode.difference_maps(means.where("side = 0"), means.where("side = 1"), "v")
    return m.select("v", _r(F.col("d_mod"), 6).alias("d_mod"), _r(F.col("d_arg"), 6).alias("d_arg"))


def experiment_difference(spark: SparkSession, d: str) -> DataFrame:
    """Moduli of one set of sessions less those of another, coloured over a range that is symmetric about zero."""
    means = inputs.cells(spark, d).groupBy(F.col("session_id") % 2, "v").agg(F.avg("re").alias("re"), F.avg("im").alias("im")).toDF("side", "v", "re", "im")
    m = means.select("side", "v", cplx.mod().alias("m"))
    diff = m.where("side = 0").select("v", F.col("m").alias("a")).join(m.where("side = 1").select("v", F.col("m").alias("b")), "v").select("v", (F.col("a") - F.col("b")).alias("d"))
    ends = encode.symmetric_range(diff, "d")
    met = diff.crossJoin(F.broadcast(ends))  # one row
    return met.select("v", _r(F.col("d"), 9).alias("d"), F.bround(254 * (F.col("d") - F.col("low")) / (F.col("high") - F.col("low")) + 1).cast("int").alias("colour"))


def beta_maps(spark: SparkSession, d: str) -> DataFrame:
    betas = inputs.cells(spark, d).select("session_id", F.col("v").alias("vertex"), (F.col("t") % 2).cast("int").alias("pc"), "re", "im", (F.col("session_id") % 2).alias("g"))
    m = encode.beta_maps(betas, "g")
    return m.select("vertex", "pc", *[_r(F.col(c), 7).alias(c) for c in m.columns[2:]])


def overlay(spark: SparkSession, d: str) -> DataFrame:
    """All courses on the group's and on the sessions' grid of time."""
    z = _scores(spark, d)
    both = encode.overlay(z, z, 2.0, 3.0)
    return both.select("kind", "pc", F.round("seconds", 6).alias("seconds"), _r(F.col("re"), 7).alias("re"), _r(F.col("im"), 7).alias("im"))


def block_offsets(spark: SparkSession, d: str) -> DataFrame:
    sizes = inputs.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return ordered.offsets(sizes, "label").select("label", "n", "offset")


def overlapping_blocks(spark: SparkSession, d: str) -> DataFrame:
    sizes = inputs.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return ordered.overlapping_blocks(sizes, 5, 20).select("label", F.col("block").cast("long").alias("block"), "first", "last")


def stratified_blocks(spark: SparkSession, d: str) -> DataFrame:
    """From each subject a contiguous block whose place is drawn by hash."""
    from pyspark.sql import Window

    e = inputs.events(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    blocks = e.withColumn("block", ordered.disjoint_block(F.col("pos"), 5))
    chosen = ordered.exact_sample(blocks.select("user_id", "block").distinct(), "block", 1, 3, "user_id")
    return blocks.join(chosen.select("user_id", "block"), ["user_id", "block"]).select("user_id", "block", "event_id")


def epoch_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of batches with a contiguous block of 20 rows of each label."""
    sizes = inputs.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return ordered.epoch_blocks(sizes, 20, 2, 9, "label")


_EPOCHS = """WITH s AS (SELECT label, count(*) n FROM embeddings GROUP BY label)
, b AS (SELECT label, n, epoch, unnest(generate_series(0, (n - 1) // 20)) block FROM s, (SELECT CAST(unnest([1, 2]) AS INTEGER) epoch))
SELECT label, epoch, CAST(row_number() OVER (PARTITION BY label, epoch ORDER BY md5('9:' || epoch || ':' || label || ':' || block), block) AS INTEGER) batch,
  CAST(block AS BIGINT) block, CAST(block * 20 AS BIGINT) AS "first", CAST(least(block * 20 + 20, n) - 1 AS BIGINT) AS "last" FROM b"""


def block_ids(spark: SparkSession, d: str) -> DataFrame:
    return ordered.block_ids(inputs.table(spark, d, "embeddings").select("vec_id"), "vec_id", 10, 4)


def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    return ordered.exact_sample(inputs.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 5)


def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    e = inputs.events(spark, d).withColumn("value", F.floor("value"))
    return e.select("event_id", ordered.average_rank("value", "visit").alias("rk"))


def mirror_pad(spark: SparkSession, d: str) -> DataFrame:
    e = inputs.obs(spark, d).select("t", "re")
    both = e.select("t", ordered.mirror_pad("re", 4, False).alias("a"), ordered.mirror_pad("re", 4, True).alias("b"))
    return both.select("t", F.size("a").cast("long").alias("n"), *[F.round(F.get(c, F.lit(i)), 8).alias(f"{c}{i}") for c in "ab" for i in (0, 3, 36, 39)])


def resample(spark: SparkSession, d: str) -> DataFrame:
    r = inputs.obs(spark, d).select("t", F.posexplode(ordered.resample_linear("re", 2.0, 3.0)).alias("k", "y"))
    return r.select("t", F.col("k").cast("long").alias("k"), _r(F.col("y"), 8).alias("y"))


def session_union(spark: SparkSession, d: str) -> DataFrame:
    """Hemispheres put one above the other, sets intersected and excepted."""
    x, half = inputs.cells(spark, d), inputs.VARIABLES // 2
    left, right = x.where(F.col("v") < half).withColumn("hemi", F.lit("lh")), x.where(F.col("v") >= half).withColumn("hemi", F.lit("rh"))
    both = left.unionByName(right)
    a, b = both.where("re > 0.2").select("t", "hemi"), both.where("im > 0.2").select("t", "hemi")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("re only"))).groupBy("hemi", "kind").agg(F.count("*").alias("n"))


_BLOCKS = EVENTS + """, p AS (SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 5) AS BIGINT) block FROM e)
, k AS (SELECT user_id, block FROM (SELECT DISTINCT user_id, block FROM p) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('3:' || block), block) = 1)"""
_SIZES = "s AS (SELECT label, count(*) n FROM embeddings GROUP BY label)"
_R2 = "r AS (SELECT CAST(user_id % 3 AS INTEGER) run, event_type pc, avg(value) r2 FROM events GROUP BY ALL)"
_TWO_PI = "6.283185307179586"

QUERIES = {
    "epoch_blocks": (epoch_blocks, _EPOCHS),
    "complex_var": (complex_var, f"WITH {CELLS} SELECT v, round(avg(re), 8) + 0.0 mean_re, round(avg(im), 8) + 0.0 mean_im, round(var_samp(re) + var_samp(im), 8) \"var\" FROM c GROUP BY v"),
    "total_variance": (total_variance, f"WITH {CELLS} SELECT round(sum(s), 8) total_var FROM (SELECT var_samp(re) + var_samp(im) s FROM c GROUP BY v)"),
    "center_scale": (center_scale, f"WITH {CELLS}, s AS (SELECT v, avg(re) a, avg(im) b, var_samp(re) + var_samp(im) q FROM c GROUP BY v) SELECT t, v, round((re - a) / CASE WHEN q > 1e-9 THEN sqrt(q) ELSE 1 END, 7) + 0.0 re, round((im - b) / CASE WHEN q > 1e-9 THEN sqrt(q) ELSE 1 END, 7) + 0.0 im FROM c JOIN s USING (v)"),
    "const_cols": (const_cols, "WITH x AS (SELECT l_suppkey s, CAST(l_partkey % 50 AS INTEGER) v, CASE WHEN l_partkey % 50 % 7 = 0 THEN 1.0::DOUBLE ELSE l_quantity END re FROM lineitem), a AS (SELECT s, v, coalesce(var_samp(re), 0) = 0 k FROM x GROUP BY s, v), b AS (SELECT v, count(*) n_sessions FROM a GROUP BY v HAVING bool_and(k)), l AS (SELECT v, count(*) n_left FROM x WHERE v NOT IN (SELECT v FROM b) GROUP BY v) SELECT coalesce(b.v, l.v) v, coalesce(n_sessions, 0) n_sessions, coalesce(n_left, 0) n_left FROM b FULL JOIN l ON b.v = l.v"),
    "magnitudes": (magnitudes, f"WITH {CELLS}, m AS (SELECT ds, sqrt(re * re + im * im) m FROM c) SELECT ds, round(avg(m), 8) mean_mod, round(quantile_cont(m, 0.5), 8) median_mod, round(quantile_cont(m, 0.75), 8) q75_mod, round(quantile_cont(m, 0.9), 8) q90_mod FROM m GROUP BY ds"),
    "magnitude_medians": (magnitude_medians, f"WITH {CELLS}, m AS (SELECT ds, v, sqrt(re * re + im * im) m FROM c), i AS (SELECT ds, v, avg(m) a, quantile_cont(m, 0.5) b, quantile_cont(m, 0.75) q, quantile_cont(m, 0.9) r FROM m GROUP BY ds, v) SELECT ds, round(quantile_cont(a, 0.5), 8) med_mean_mod, round(quantile_cont(b, 0.5), 8) med_median_mod, round(quantile_cont(q, 0.5), 8) med_q75_mod, round(quantile_cont(r, 0.5), 8) med_q90_mod FROM i GROUP BY ds"),
    "gram": (gram, f"WITH {CELLS} SELECT a.v i, b.v j, round(sum(a.re * b.re + a.im * b.im), 7) + 0.0 re, round(sum(a.re * b.im - a.im * b.re), 7) + 0.0 im FROM c a JOIN c b ON a.t = b.t GROUP BY a.v, b.v"),
    "mod_arg": (mod_arg, f"WITH {CELLS}, g AS (SELECT v, avg(re) re, avg(im) im FROM c GROUP BY v) SELECT v, round(sqrt(re * re + im * im), 8) \"mod\", round(atan2(im, re), 7) + 0.0 arg, round(sqrt(re * re + im * im), 8) mod2, CAST(0 AS DOUBLE) zero FROM g"),
    "wrap_phase": (wrap_phase, f"SELECT event_id, round(value - {_TWO_PI} * floor(value / {_TWO_PI}) - pi(), 7) + 0.0 wrapped FROM events"),
    "adjust_phase": (adjust_phase, f"WITH {CELLS}, x AS (SELECT v, atan2(im, re) p FROM c), g AS (SELECT unnest(generate_series(0, 47)) step), k AS (SELECT v, step, p - step * ({_TWO_PI} / 48) q FROM x, g), u AS (SELECT v, step, q - {_TWO_PI} * floor(q / {_TWO_PI}) - pi() u FROM k), b AS (SELECT v, step FROM u GROUP BY v, step QUALIFY row_number() OVER (PARTITION BY v ORDER BY round(abs(avg(u)), 9), step) = 1) SELECT u.v, CAST(step AS INTEGER) step, count(*) n, round(min(u), 6) + 0.0 low, round(max(u), 6) + 0.0 high FROM u JOIN b USING (v, step) GROUP BY u.v, step"),
    "scatter_full": (scatter_full, "SELECT p_partkey vertex, value FROM part LEFT JOIN (SELECT l_partkey, round(avg(l_extendedprice), 7) value FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.05 GROUP BY 1) ON l_partkey = p_partkey"),
    "cortex_rows": (cortex_rows, "SELECT c_mktsegment \"label\", count(*) n, count(DISTINCT c_custkey) n_vertices FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING') GROUP BY 1"),
    "fixed_scores": (fixed_scores, f"WITH {SCORES} SELECT t, pc, round(re, 7) + 0.0 re, round(im, 7) + 0.0 im FROM z"),
    "group_ev": (group_ev, f"WITH {SCORES}, s AS (SELECT sum(q) q FROM (SELECT var_samp(re) + var_samp(im) q FROM c GROUP BY v)) SELECT pc, round((var_samp(re) + var_samp(im)) / (SELECT q FROM s), 8) r2 FROM z GROUP BY pc"),
    "fit_ev": (
        fit_ev,
        f"""WITH {CELLS}, {WEIGHTS}
, m AS (SELECT v, avg(re) mr, avg(im) mi, var_samp(re) + var_samp(im) q FROM c GROUP BY v)
, x AS (
  SELECT ds, t, v, (re - mr) / CASE WHEN q > 1e-9 THEN sqrt(q) ELSE 1 END re, (im - mi) / CASE WHEN q > 1e-9 THEN sqrt(q) ELSE 1 END im
  FROM c JOIN m USING (v))
, z AS (SELECT ds, t, pc, sum(re * wr - im * wi) re, sum(re * wi + im * wr) im FROM x JOIN w USING (v) GROUP BY ds, t, pc)
, s AS (SELECT ds, sum(q) q FROM (SELECT ds, var_samp(re) + var_samp(im) q FROM x GROUP BY ds, v) GROUP BY ds)
SELECT z.ds, pc, round((var_samp(re) + var_samp(im)) / any_value(q), 8) r2 FROM z JOIN s ON s.ds = z.ds GROUP BY z.ds, pc""",
    ),
    "individual_ev": (individual_ev, f"WITH {SCORES}, s AS (SELECT ds, sum(q) q FROM (SELECT ds, var_samp(re) + var_samp(im) q FROM c GROUP BY ds, v) GROUP BY ds) SELECT z.ds, pc, round((var_samp(re) + var_samp(im)) / any_value(q), 8) r2 FROM z JOIN s ON s.ds = z.ds GROUP BY z.ds, pc"),
    "slice_ev": (slice_ev, f"WITH {CELLS}, r AS (SELECT ds, t, pc, cos(CAST(t * (pc + 1) AS DOUBLE)) wr, sin(CAST(t + pc AS DOUBLE)) wi FROM (SELECT DISTINCT ds, t FROM c), (SELECT CAST(unnest([0, 1]) AS INTEGER) pc)), n AS (SELECT *, sqrt(sum(wr * wr + wi * wi) OVER (PARTITION BY ds, pc)) q FROM r), m AS (SELECT c.ds, pc, v, sum(re * wr / q - im * wi / q) re, sum(re * wi / q + im * wr / q) im FROM c JOIN n ON n.ds = c.ds AND n.t = c.t GROUP BY ALL), s AS (SELECT ds, sum(k) k FROM (SELECT ds, t, var_samp(re) + var_samp(im) k FROM c GROUP BY ds, t) GROUP BY ds) SELECT m.ds, pc, round((var_samp(re) + var_samp(im)) / any_value(k), 8) r2 FROM m JOIN s ON s.ds = m.ds GROUP BY m.ds, pc"),
    "posthoc_slope": (posthoc_slope, f"WITH {SCORES}, j AS (SELECT v, pc, c.re yr, c.im yi, z.re zr, z.im zi FROM c JOIN z ON z.t = c.t), m AS (SELECT *, avg(yr) OVER w a, avg(yi) OVER w b, avg(zr) OVER w p, avg(zi) OVER w q FROM j WINDOW w AS (PARTITION BY v, pc)) SELECT v, pc, round(sum((zr-p)*(yr-a)+(zi-q)*(yi-b)) / sum((zr-p)**2+(zi-q)**2), 6) + 0.0 re, round(sum((zr-p)*(yi-b)-(zi-q)*(yr-a)) / sum((zr-p)**2+(zi-q)**2), 6) + 0.0 im FROM m GROUP BY v, pc"),
    "mcc": (mcc, f"WITH {CELLS}, j AS (SELECT a.v, a.re ar, a.im ai, b.re br, b.im bi FROM c a JOIN c b ON a.t = b.t AND a.v = b.v + 1), m AS (SELECT v, ar - avg(ar) OVER w ar, ai - avg(ai) OVER w ai, br - avg(br) OVER w br, bi - avg(bi) OVER w bi FROM j WINDOW w AS (PARTITION BY v)) SELECT v, round(sqrt(sum(ar*br+ai*bi)**2 + sum(ai*br-ar*bi)**2) / sqrt(sum(ar*ar+ai*ai) * sum(br*br+bi*bi)), 7) mcc FROM m GROUP BY v"),
    "mcc_share": (mcc_share, "WITH m AS (SELECT CAST(user_id % 2 AS BIGINT) g, least(value, 100.0) / 100 m FROM events) SELECT g, count(*) FILTER (m > 0.95) n_95, round(avg(CAST(m > 0.95 AS DOUBLE)), 9) share_95, count(*) FILTER (m > 0.975) n_975, round(avg(CAST(m > 0.975 AS DOUBLE)), 9) share_975 FROM m GROUP BY g"),
    "cum_best": (cum_best, "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) best FROM events"),
    "run_variance": (run_variance, f"WITH {CELLS} SELECT v, round(var_samp(re) + var_samp(im), 9) \"var\" FROM (SELECT ds, v, avg(re) re, avg(im) im FROM c GROUP BY ds, v) GROUP BY v"),
    "best_run": (best_run, f"WITH {_R2}, b AS (SELECT pc, run, r2 FROM r QUALIFY row_number() OVER (PARTITION BY pc ORDER BY r2 DESC, run) = 1), m AS (SELECT run mode_run, count(*) mode_n FROM b GROUP BY run ORDER BY 2 DESC, 1 LIMIT 1) SELECT pc, run, round(r2, 9) r2, mode_run, mode_n FROM b, m"),
    "scree_share": (scree_share, f"WITH {_R2} SELECT run, pc, round(r2 * r2 / sum(r2 * r2) OVER (PARTITION BY run), 8) \"share\" FROM r"),
    "dominance": (dominance, "WITH w AS (SELECT user_id, avg(value) FILTER (event_type = 'click') a, greatest(avg(value) FILTER (event_type = 'error'), avg(value) FILTER (event_type = 'login'), avg(value) FILTER (event_type = 'purchase'), avg(value) FILTER (event_type = 'view'), CAST('-inf' AS DOUBLE)) b FROM events GROUP BY user_id) SELECT CAST(user_id % 2 AS BIGINT) g, CAST(user_id % 3 AS BIGINT) visit, round(avg(CAST(b > a AS DOUBLE)), 9) \"share\", count(*) n FROM w GROUP BY 1, 2"),
    "box_summary": (box_summary, f"WITH {EVENTS} SELECT g, visit, round(min(value), 9) low, round(quantile_cont(value, 0.25), 9) q1, round(quantile_cont(value, 0.5), 9) median, round(quantile_cont(value, 0.75), 9) q3, round(max(value), 9) high FROM e GROUP BY g, visit"),
    "color_range": (color_range, "SELECT event_type, min(value) low, max(value) high, round(max(abs(value - 50)), 9) sym FROM events GROUP BY 1"),
    "color_bin": (color_bin, "WITH m AS (SELECT min(value) a, max(value) b FROM events), x AS (SELECT event_id, 255 * (value - a) / (b - a) + 1 x, 100 * (value - 0.0) / 50.0 + 1 y FROM events, m) SELECT event_id, CAST(round_even(x, 0) AS INTEGER) free, CAST(round_even(y, 0) AS INTEGER) fixed FROM x"),
    "pval_color": (pval_color, "SELECT event_id, CASE WHEN value / 200 < 0.001 THEN 4 WHEN value / 200 < 0.01 THEN 3 WHEN value / 200 < 0.05 THEN 2 WHEN value / 200 < 0.1 THEN 1 ELSE 0 END \"class\", CASE WHEN event_id % 11 = 0 THEN 'gray33' WHEN value / 200 < 0.001 THEN 'darkred' WHEN value / 200 < 0.01 THEN 'red' WHEN value / 200 < 0.05 THEN 'orange' WHEN value / 200 < 0.1 THEN 'yellow' ELSE 'white' END colour FROM events"),
    "time_courses": (time_courses, f"WITH {SCORES} SELECT t, pc, t / CAST(2.0 AS DOUBLE) AS seconds, round(sqrt(re * re + im * im), 7) \"mod\", round(atan2(im, re), 6) + 0.0 arg FROM z"),
    "difference_maps": (difference_maps, f"WITH {CELLS}, m AS (SELECT ds % 2 s, v, avg(re) re, avg(im) im FROM c GROUP BY 1, 2), k AS (SELECT a.v, sqrt(a.re**2 + a.im**2) - sqrt(b.re**2 + b.im**2) d, atan2(a.im, a.re) - atan2(b.im, b.re) p FROM m a JOIN m b ON a.v = b.v AND a.s = 0 AND b.s = 1) SELECT v, round(sign(d) * sqrt(abs(d)), 6) + 0.0 d_mod, round(p - {_TWO_PI} * floor(p / {_TWO_PI}) - pi(), 6) + 0.0 d_arg FROM k"),
    "experiment_difference": (experiment_difference, f"WITH {CELLS}, m AS (SELECT ds % 2 s, v, avg(re) re, avg(im) im FROM c GROUP BY 1, 2), k AS (SELECT a.v, sqrt(a.re**2 + a.im**2) - sqrt(b.re**2 + b.im**2) d FROM m a JOIN m b ON a.v = b.v AND a.s = 0 AND b.s = 1), t AS (SELECT max(abs(d)) x FROM k) SELECT v, round(d, 9) + 0.0 d, CAST(round_even(254 * (d + x) / (2 * x) + 1, 0) AS INTEGER) colour FROM k, t"),
    "beta_maps": (beta_maps, f"WITH {CELLS}, m AS (SELECT v vertex, CAST(t % 2 AS INTEGER) pc, avg(re) FILTER (ds % 2 = 0) r0, avg(im) FILTER (ds % 2 = 0) i0, avg(re) FILTER (ds % 2 = 1) r1, avg(im) FILTER (ds % 2 = 1) i1 FROM c GROUP BY 1, 2) SELECT vertex, pc, round(sqrt(sqrt(r0**2 + i0**2)), 7) root_mod0, round(sqrt(sqrt(r1**2 + i1**2)), 7) root_mod1, round(sqrt(sqrt((r0 - r1)**2 + (i0 - i1)**2)), 7) root_mod_diff FROM m"),
    "overlay": (overlay, f"WITH {SCORES} SELECT kind, pc, round(t / fs, 6) AS seconds, round(re, 7) + 0.0 re, round(im, 7) + 0.0 im FROM z, (VALUES ('group', 2.0::DOUBLE), ('single', 3.0::DOUBLE)) k(kind, fs)"),
    "block_offsets": (block_offsets, f"WITH {_SIZES} SELECT \"label\", n, CAST(coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) \"offset\" FROM s"),
    "overlapping_blocks": (overlapping_blocks, f"WITH {_SIZES}, b AS (SELECT label, n, unnest(generate_series(0, 4)) block FROM s), f AS (SELECT label, n, block, CAST(floor(greatest(n - 20, 0) * block / 4) AS BIGINT) \"first\" FROM b) SELECT \"label\", block, \"first\", CAST(least(\"first\" + 20, n) AS BIGINT) - 1 \"last\" FROM f"),
    "stratified_blocks": (stratified_blocks, f"WITH {_BLOCKS} SELECT p.user_id, p.block, event_id FROM p JOIN k ON k.user_id = p.user_id AND k.block = p.block"),
    "block_ids": (block_ids, "SELECT vec_id, CAST(row_number() OVER (ORDER BY md5('4:' || vec_id), vec_id) % 10 + 1 AS BIGINT) block FROM embeddings"),
    "exact_sample": (exact_sample, "SELECT c_custkey, c_name FROM customer ORDER BY md5('5:' || c_custkey), c_custkey LIMIT 100"),
    "average_ranks": (average_ranks, f"WITH {EVENTS}, f AS (SELECT event_id, visit, floor(value) x FROM e) SELECT event_id, CAST(rank() OVER (PARTITION BY visit ORDER BY x) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY visit, x) AS DOUBLE) - 1) / 2 rk FROM f"),
    "mirror_pad": (mirror_pad, "WITH x AS (SELECT vec_id t, CAST(embedding[1:32] AS DOUBLE[]) y FROM embeddings), p AS (SELECT t, list_concat(list_concat(list_reverse(y[2:5]), y), list_reverse(y[28:31])) a, list_concat(list_concat(list_reverse(y[1:4]), y), list_reverse(y[29:32])) b FROM x) SELECT t, CAST(len(a) AS BIGINT) n, " + ", ".join(f"round({c}[{i + 1}], 8) {c}{i}" for c in "ab" for i in (0, 3, 36, 39)) + " FROM p"),
    "resample": (resample, "WITH x AS (SELECT vec_id t, CAST(embedding[1:32] AS DOUBLE[]) y, unnest(generate_series(0, 47)) k FROM embeddings), p AS (SELECT t, k, y, k * (2.0::DOUBLE / 3.0::DOUBLE) x FROM x) SELECT t, k, round(CASE WHEN x = floor(x) THEN y[CAST(floor(x) AS INTEGER) + 1] ELSE y[CAST(floor(x) AS INTEGER) + 1] + (y[CAST(floor(x) AS INTEGER) + 2] - y[CAST(floor(x) AS INTEGER) + 1]) * (x - floor(x)) END, 8) + 0.0 y FROM p"),
    "session_union": (session_union, f"WITH {CELLS}, h AS (SELECT t, CASE WHEN v < 16 THEN 'lh' ELSE 'rh' END hemi, re, im FROM c), a AS (SELECT DISTINCT t, hemi FROM h WHERE re > 0.2), b AS (SELECT DISTINCT t, hemi FROM h WHERE im > 0.2), i AS (SELECT * FROM a INTERSECT SELECT * FROM b) SELECT hemi, kind, count(*) n FROM (SELECT hemi, 'both' kind FROM i UNION ALL SELECT hemi, 're only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY hemi, kind"),
}
