"""Queries on tests, permutations, meshes, signals and decompositions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evar, linalg, mesh, ordered, qr, signal, simulate, stats
from . import inputs, solver_sql
from .inputs import CELLS, EVENTS, FACES, RP, SURFACE


#: Shuffles of the permutation tests and of the cluster test, its level and least cluster (fixed values, the survey's).
SHUFFLES, CLUSTER_SHUFFLES, ALPHA, LEAST = 999, 1000, 0.005, 5


def _r(c, n: int):
    return F.round(c, n) + 0.0


def _values(spark, d) -> DataFrame:
    e = inputs.events(spark, d)
    return e.select(F.col("event_type").alias("vertex"), F.col("user_id").alias("subject"), "g", F.floor("value").cast("double").alias("value"))


def _pairs(spark, d) -> DataFrame:
    e = inputs.events(spark, d)
    # a mean that is a whole number is cut to it or to the one below, by the order in which it was summed
    means = ordered.ordered_means(e, ["user_id", "event_type", "visit"], "value", "event_id")
    floor = F.floor("mean").cast("double")
    m = means.groupBy("user_id", "event_type").agg(*[F.max(F.when(F.col("visit") == v, floor)).alias(v.lower()) for v in ("V1", "V2")])
    return m.where("v1 is not null and v2 is not null").withColumnRenamed("event_type", "vertex")


def wilcoxon_w(spark: SparkSession, d: str) -> DataFrame:
    w = stats.rank_sum(_values(spark, d), "vertex", p=False)
    return w.select("vertex", "w", "n0", "n1", "ties")


def wilcoxon_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_sum(_values(spark, d), "vertex").select("vertex", "w", _r(F.col("p"), 6).alias("p"))


def signed_rank(spark: SparkSession, d: str) -> DataFrame:
    s = stats.signed_rank(_pairs(spark, d), "vertex", p=False)
    return s.select("vertex", "v", "n", "ties")


def welch(spark: SparkSession, d: str) -> DataFrame:
    return stats.welch(_values(spark, d), "vertex", p=False).select("vertex", _r(F.col("t"), 7).alias("t"), _r(F.col("df"), 5).alias("df"))


def t_tests(spark: SparkSession, d: str) -> DataFrame:
    told = [_r(F.col("t"), 7).alias("t"), _r(F.col("df"), 5).alias("df"), _r(F.col("p"), 6).alias("p")]
    a = stats.welch(_values(spark, d), "vertex").select("vertex", F.lit("welch").alias("test"), *told)
    return a.unionByName(stats.paired_t(_pairs(spark, d), "vertex").select("vertex", F.lit("paired").alias("test"), *told))


def paired_t(spark: SparkSession, d: str) -> DataFrame:
    return stats.paired_t(_pairs(spark, d), "vertex", p=False).select("vertex", _r(F.col("t"), 7).alias("t"), "df")


CONTRASTS = [("gcv2_gcv1", "g = 0 and visit = 'V2'", "g = 0 and visit = 'V1'"), ("gpv2_gpv1", "g = 1 and visit = 'V2'", "g = 1 and visit = 'V1'"), ("gpv1_gcv1", "g = 1 and visit = 'V1'", "g = 0 and visit = 'V1'"), ("gpv2_gcv2", "g = 1 and visit = 'V2'", "g = 0 and visit = 'V2'"), ("v2_v1", "visit = 'V2'", "visit = 'V1'"), ("gp_gc", "g = 1", "g = 0")]


def contrast_means(spark: SparkSession, d: str) -> DataFrame:
    c = stats.contrasts(inputs.events(spark, d).select("user_id", "g", "visit", "value"), CONTRASTS)
    return c.groupBy("contrast").agg(_r(stats.mean_difference("value", "side"), 9).alias("diff"), F.count("*").alias("n"))


def permuted_labels(spark: SparkSession, d: str) -> DataFrame:
    return stats.permuted_labels(_values(spark, d).select("subject", "g"), 3)


def perm_p(spark: SparkSession, d: str) -> DataFrame:
    x = _values(spark, d)
    labels = stats.shuffles(x.select("subject", "g"), SHUFFLES)
    p = stats.permutation_p(x.drop("g"), labels, "vertex")
    return p.select("vertex", _r(F.col("diff"), 9).alias("diff"), F.round("p", 6).alias("p"))


def perm_p_paired(spark: SparkSession, d: str) -> DataFrame:
    """Labels shuffled among sessions (a session is a subject's visit), regardless of subjects."""
    e = inputs.events(spark, d).select("event_type", (F.col("user_id") * 2 + F.when(F.col("visit") == "V2", 1).otherwise(0)).alias("subject"), F.when(F.col("visit") == "V2", 1).otherwise(0).cast("long").alias("g"), F.floor("value").cast("double").alias("value"))
    labels = stats.shuffles(e.select("subject", "g"), SHUFFLES)
    p = stats.permutation_p(e.drop("g"), labels, "event_type")
    return p.select(F.col("event_type").alias("vertex"), _r(F.col("diff"), 9).alias("diff"), F.round("p", 6).alias("p"))


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges of the whole mesh, counted by their start."""
    return mesh.neighbours(inputs.faces(spark, d)).groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("least"), F.max("dst").alias("most"))


def neighbor_lists(spark: SparkSession, d: str) -> DataFrame:
    n = mesh.neighbour_lists(mesh.neighbours(inputs.faces(spark, d)))
    return n.select("vertex", F.size("neighbours").cast("long").alias("n"), F.md5(F.array_join("neighbours", ",")).alias("digest"))


def _z(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each vertex's mean quantity against that of all, in standard errors; and all edges."""
    f = inputs.faces(spark, d)
    values = f.select(F.explode(F.array("a", "b", "c")).alias("vertex"), "l_quantity")
    total = f.agg(F.avg("l_quantity").alias("mu"), F.stddev_samp("l_quantity").alias("sd"))
    z = values.groupBy("vertex").agg(F.avg("l_quantity").alias("m"), F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return z.select("vertex", F.round((F.col("m") - F.col("mu")) / (F.col("sd") / F.sqrt(F.col("n").cast("double"))), 6).alias("z")), mesh.neighbours(f)


def components(spark: SparkSession, d: str) -> DataFrame:
    z, e = _z(spark, d)
    return mesh.components(z.where("z > 1.96"), e)


def _cluster_test(spark, d) -> tuple[DataFrame, DataFrame]:
    x, faces = inputs.surface(spark, d)
    return mesh.cluster_test(x, mesh.neighbours(faces, "hemi"), x.select("subject", "g"), CLUSTER_SHUFFLES, ALPHA, LEAST, ("hemi",))


def max_cluster_null(spark: SparkSession, d: str) -> DataFrame:
    """Largest cluster of vertices with different rank sums by shuffle of the subjects' labels, and its 95 % quantile."""
    null = _cluster_test(spark, d)[1]
    return null.crossJoin(F.broadcast(mesh.limit(null))).select("sim", "max_size", F.col("limit").alias("limit95"))  # one row


def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    """The clusters under the labels as they are, by hemisphere, against the limit of the shuffles."""
    r = mesh.report(*_cluster_test(spark, d), "hemi")
    return r.select("hemi", "n_clusters", F.get("sizes", F.lit(0)).alias("largest"), _r(F.col("limit"), 6).alias("limit95"), "n_over")


# --- signals: not SQL, but for one regressor --------------------------------------------------------------------------


def ols_resid(spark: SparkSession, d: str) -> DataFrame:
    """Residuals on one regressor as native aggregates."""
    e = inputs.events(spark, d).select("event_id", "user_id", "value", (F.col("event_id") % 97).cast("double").alias("x"))
    s = e.groupBy("user_id").agg(F.regr_slope("value", "x").alias("b"), F.regr_intercept("value", "x").alias("a"))
    return e.join(s, "user_id").select("event_id", _r(F.col("value") - F.col("a") - F.col("b") * F.col("x"), 6).alias("resid"))


def _series(spark, d) -> tuple[DataFrame, DataFrame]:
    """All frames by supplier: three series and the six parameters."""
    m = inputs.motion(spark, d, "string").withColumn("t", (F.col("t") - 1).cast("int"))
    # all six, so that the series and the parameters are read from one shuffle
    li = m.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", *signal.MOTION))).alias("a"))
    y = li.select("session_id", F.lit("lh").alias("hemi"), F.posexplode(F.array(F.transform("a", lambda x: x["p1"] + F.sin(x["t"].cast("double"))), F.transform("a", lambda x: x["p2"] * 2), F.transform("a", lambda x: x["p3"] - x["t"] / 10))).alias("vertex", "y"))
    return y, m


def nuisance_resid(spark: SparkSession, d: str) -> DataFrame:
    y, m = _series(spark, d)
    z = signal.nuisance(y, m.withColumn("p1", F.col("t") % 5 + 0.0), absolute=False)
    return z.select("session_id", "vertex", F.posexplode("y").alias("t", "resid")).withColumn("resid", _r(F.col("resid"), 6))


def psd_norm(spark: SparkSession, d: str) -> DataFrame:
    return signal.spectral_norm(_series(spark, d)[0], 0.5).select("session_id", _r(F.col("norm"), 6).alias("norm"))


def band_pass(spark: SparkSession, d: str) -> DataFrame:
    found = signal.band_passed(_series(spark, d)[0], 0.5).select("session_id", "vertex", F.posexplode("y").alias("t", "y"))
    return found.withColumn("y", _r(F.col("y"), 5))


def analytic_signal(spark: SparkSession, d: str) -> DataFrame:
    z = signal.analytic_signal(_series(spark, d)[0], 0.5)
    found = z.select("session_id", "vertex", F.posexplode(F.arrays_zip("re", "im")).alias("t", "z"))
    return found.select("session_id", "vertex", "t", _r(F.col("z.re"), 5).alias("re"), _r(F.col("z.im"), 5).alias("im"))


def preprocess(spark: SparkSession, d: str) -> DataFrame:
    y, m = _series(spark, d)
    valid = spark.createDataFrame([("lh", 0), ("lh", 2)], "hemi string, vertex int")
    known = [x.where("session_id is not null") for x in (y, m)]  # the same rows of both, again for one shuffle
    obs = signal.preprocess_obs(*known, valid, 0.5, 1.0, absolute=True)
    return obs.select("session_id", "t", _r(F.col("re")[0], 5).alias("re0"), _r(F.col("im")[0], 5).alias("im0"), F.size("re").alias("n"))


# --- decompositions ---------------------------------------------------------------------------------------------------

K = 3
#: Rows of a start, momentum, and Oja's rates of learning.
START_ROWS, BETA, RATES = 100, 1e-5, linalg.log_linear(5.0, 0.5, 5)


def _matrix(spark, d) -> DataFrame:
    return inputs.obs(spark, d)


def _result(spark, x: DataFrame, w: np.ndarray) -> DataFrame:
    share = linalg.explained(x, w)
    table = spark.createDataFrame([(i, float(r)) for i, r in enumerate(share)], "pc int, r2 double")
    return linalg.loadings(spark, w).join(F.broadcast(table), "pc").select("pc", "vertex", "re", "im", "r2")


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("pc", "vertex", _r(F.col("re"), 6).alias("re"), _r(F.col("im"), 6).alias("im"), _r(F.col("r2"), 8).alias("r2"))


def cpca_exact(spark: SparkSession, d: str) -> DataFrame:
    x = _matrix(spark, d)
    return _rounded(_result(spark, x, linalg.exact(x, K)))


def cpca_dual(spark: SparkSession, d: str) -> DataFrame:
    """The same directions through the product of rows with rows."""
    x = _matrix(spark, d)
    return _rounded(_result(spark, x, linalg.dual(x, K)))


def cpca_tree(spark: SparkSession, d: str) -> DataFrame:
    """The same through a tree of triangular factors, with the singular values."""
    x = _matrix(spark, d)
    s, w = qr.singular(x, K)
    values = spark.createDataFrame([(pc, float(v)) for pc, v in enumerate(s)], "pc int, singular double")
    return _rounded(_result(spark, x, w)).join(F.broadcast(values), "pc").select("pc", "vertex", "re", "im", "r2", _r(F.col("singular"), 7).alias("singular"))


def cpca_rsvd(spark: SparkSession, d: str) -> DataFrame:
    x = _matrix(spark, d)
    return _rounded(_result(spark, x, linalg.randomised(x, K)))


def cpca_pim(spark: SparkSession, d: str) -> DataFrame:
    x = _matrix(spark, d)
    return _rounded(_result(spark, x, linalg.pim(x, linalg.sample_start(x, K, START_ROWS), 4, BETA).w))


def cpca_pimvr(spark: SparkSession, d: str) -> DataFrame:
    x = _matrix(spark, d)
    return _rounded(_result(spark, x, linalg.pimvr(x, linalg.sample_start(x, K, START_ROWS), 2, 3, BETA).w))


def cpca_oja(spark: SparkSession, d: str) -> DataFrame:
    x = _matrix(spark, d)
    return _rounded(_result(spark, x, linalg.oja(x, linalg.start(inputs.VARIABLES, K), len(RATES), RATES).w))


def cpca_restarts(spark: SparkSession, d: str) -> DataFrame:
    """Two runs with reduced variance side by side, each from rows and with mini-batches of its own."""
    x = _matrix(spark, d)
    fits = linalg.pimvr_restarts(x, [linalg.sample_start(x, K, START_ROWS, run) for run in range(2)], 2, 3, BETA)
    found = spark.createDataFrame([(run, pc, float(r)) for run, _, r2 in fits for pc, r in enumerate(r2)], "run int, pc int, r2 double")
    return found.select("run", "pc", _r(F.col("r2"), 8).alias("r2"))


def magnitude_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Ten draws of one to three sessions that are scaled by 2, 5 or 10: how many, their largest factor, and the shares of
    the matrix that its first components then have.
    """
    x = _matrix(spark, d)
    draws = linalg.magnitude_draws([r[0] for r in x.select("session_id").distinct().collect() if r[0] is not None])
    rows = [(i, len(c), max(c.values()), pc, float(v)) for i, (c, (_, share)) in enumerate(zip(draws, linalg.magnitude_experiment(x, K, draws))) for pc, v in enumerate(share)]
    found = spark.createDataFrame(rows, "draw int, n_scaled int, factor double, pc int, r2 double")
    return found.select("draw", "n_scaled", "factor", "pc", _r(F.col("r2"), 8).alias("r2"))


def solver_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Share of components that a solver finds again, over runs with other mini-batches and starts on the whole matrix."""
    m = simulate.agreement_on(_matrix(spark, d), simulate.by_pimvr, K, 5)
    return evar.share_over(m, "mcc", [0.95, 0.975], "pc")


_PAIRS = EVENTS + ", p AS (SELECT event_type vertex, user_id, floor(avg(value) FILTER (visit = 'V1')) v1, floor(avg(value) FILTER (visit = 'V2')) v2 FROM e GROUP BY ALL HAVING v1 IS NOT NULL AND v2 IS NOT NULL)"
_MESH = FACES + """, n AS (SELECT DISTINCT src, dst FROM (SELECT a src, b dst FROM f UNION ALL SELECT b, a FROM f UNION ALL SELECT a, c FROM f UNION ALL SELECT c, a FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, b FROM f))"""
_Z = _MESH + """, g AS (SELECT avg(l_quantity) mu, stddev_samp(l_quantity) sd FROM f)
, s AS (SELECT v, round((avg(l_quantity) - any_value(mu)) / (any_value(sd) / sqrt(count(*))), 6) z FROM (SELECT unnest([a, b, c]) v, l_quantity FROM f), g GROUP BY v)"""
_COMP = _Z + """, k AS (SELECT v FROM s WHERE z > 1.96), i AS (SELECT src, dst FROM n JOIN k x ON x.v = src JOIN k y ON y.v = dst)
, q(v, c) AS (SELECT v, v FROM k UNION SELECT i.dst, q.c FROM q JOIN i ON i.src = q.v), o AS (SELECT v vertex, min(c) component FROM q GROUP BY v)"""


def _perm(subject: str, label: str, sims: int) -> str:
    """Labels by simulation, ``k(sim, subject, g)``, each shuffled in the order of a hash."""
    return _values_of(subject, label) + _LABELS.format(sims=sims)


def _values_of(subject: str, label: str) -> str:
    return f"""
, x AS (SELECT event_type vertex, {subject} subject, {label} g, floor(value) val FROM e)"""


_LABELS = """
, u AS (SELECT subject, min(g) g, row_number() OVER (ORDER BY subject) pos FROM x GROUP BY subject)
, l AS (
  SELECT sim, g, row_number() OVER (PARTITION BY sim ORDER BY CASE WHEN sim = 0 THEN '' ELSE md5('0:' || sim || ':' || subject) END, subject) pos
  FROM u, (SELECT CAST(unnest(generate_series(0, {sims})) AS INTEGER) sim))
, k AS (SELECT sim, u.subject, l.g FROM l JOIN u ON u.pos = l.pos)"""

#: Rank sums by vertex and simulation, the significant vertices, their clusters and the largest of each simulation.
_CLUSTERS = SURFACE + _LABELS.format(sims=CLUSTER_SHUFFLES) + """
, r AS (
  SELECT vertex, subject,
    CAST(rank() OVER (PARTITION BY vertex ORDER BY val) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY vertex, val) AS DOUBLE) - 1) / 2 rk,
    CAST(count(*) OVER (PARTITION BY vertex, val) AS DOUBLE) t
  FROM x)
, b AS (SELECT vertex, subject, sum(rk) s, CAST(count(*) AS DOUBLE) n, sum(t * t - 1) ties FROM r GROUP BY vertex, subject)
, w AS (
  SELECT vertex, sim, sum(CASE WHEN g = 0 THEN s ELSE 0 END) s, sum(CASE WHEN g = 0 THEN n ELSE 0 END) n0, sum(CASE WHEN g = 1 THEN n ELSE 0 END) n1, sum(ties) ties
  FROM b JOIN k USING (subject) GROUP BY vertex, sim)
, a AS (
  SELECT vertex, sim FROM w
  WHERE abs(abs(s - n0 * (n0 + 1) / 2 - n0 * n1 / 2) - 0.5) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) > 2.807033768343811)
, i AS (SELECT p.sim, src, dst FROM n JOIN a p ON p.vertex = src JOIN a q ON q.vertex = dst AND q.sim = p.sim)
, q(sim, v, c) AS (SELECT sim, vertex, vertex FROM a UNION SELECT q.sim, i.dst, q.c FROM q JOIN i ON i.src = q.v AND i.sim = q.sim)
, o AS (SELECT sim, v, min(c) c FROM q GROUP BY sim, v)
, z AS (SELECT sim, c, count(*) m FROM o GROUP BY sim, c)
, y AS (SELECT k.sim, coalesce(max(m), 0) max_size FROM (SELECT DISTINCT sim FROM k WHERE sim > 0) k LEFT JOIN z ON z.sim = k.sim GROUP BY k.sim)
, lim AS (SELECT quantile_cont(CAST(max_size AS DOUBLE), 0.95) limit95 FROM y)"""

_PVALUE = """
, m AS (SELECT vertex, sim, avg(val) FILTER (k.g = 0) - avg(val) FILTER (k.g = 1) d FROM x JOIN k ON k.subject = x.subject GROUP BY vertex, sim)
, o AS (SELECT vertex, d FROM m WHERE sim = 0)
SELECT m.vertex, round(any_value(o.d), 9) + 0.0 diff, round(CAST(count(*) FILTER (sim > 0 AND abs(m.d) >= abs(o.d) - 1e-12) + 1 AS DOUBLE) / count(*), 6) p FROM m JOIN o ON o.vertex = m.vertex GROUP BY m.vertex"""

#: Ranks of values by vertex, and the rank-sum statistic with what its distribution needs.
_RANKS = """, x AS (SELECT event_type vertex, g, floor(value) v FROM e)
, r AS (
  SELECT vertex, g,
    CAST(rank() OVER (PARTITION BY vertex ORDER BY v) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY vertex, v) AS DOUBLE) - 1) / 2 rk,
    CAST(count(*) OVER (PARTITION BY vertex, v) AS DOUBLE) t
  FROM x)
, w AS (
  SELECT vertex, sum(rk) FILTER (g = 0) - CAST(count(*) FILTER (g = 0) AS DOUBLE) * (CAST(count(*) FILTER (g = 0) AS DOUBLE) + 1) / 2 w,
    count(*) FILTER (g = 0) n0, count(*) FILTER (g = 1) n1, sum(t * t - 1) ties
  FROM r GROUP BY vertex)"""
#: Simpson's rule on 4,000 steps: places from 0 to 1 and weights.
_SIMPSON = """, steps AS (SELECT i / 4000.0 u, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 12000.0 h FROM (SELECT unnest(generate_series(0, 4000)) i))"""
_WILCOXON_P = f"""WITH {EVENTS}{_RANKS}{_SIMPSON}
, z AS (SELECT vertex, w, abs(abs(w - n0 * n1 / 2) - 0.5) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / (CAST(n0 + n1 AS DOUBLE) * (n0 + n1 - 1)))) z FROM w)
SELECT vertex, any_value(w) w, round(1 - sqrt(2 / pi()) * any_value(z) * sum(h * exp(-z * z * u * u / 2)), 6) + 0.0 p FROM z, steps GROUP BY vertex"""
_T_P = f"""WITH {_PAIRS}{_SIMPSON}
, s AS (
  SELECT event_type vertex, avg(floor(value)) FILTER (g = 0) m0, avg(floor(value)) FILTER (g = 1) m1,
    var_samp(floor(value)) FILTER (g = 0) / count(*) FILTER (g = 0) a, var_samp(floor(value)) FILTER (g = 1) / count(*) FILTER (g = 1) b,
    count(*) FILTER (g = 0) n0, count(*) FILTER (g = 1) n1
  FROM e GROUP BY 1)
, t AS (
  SELECT vertex, 'welch' test, (m0 - m1) / sqrt(a + b) t, (a + b)**2 / (a * a / (n0 - 1) + b * b / (n1 - 1)) df FROM s
  UNION ALL SELECT vertex, 'paired', avg(v1 - v2) / (stddev_samp(v1 - v2) / sqrt(count(*))), CAST(count(*) - 1 AS DOUBLE) FROM p GROUP BY vertex)
, q AS (SELECT *, atan(abs(t) / sqrt(df)) o, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) c FROM t)
SELECT vertex, test, round(any_value(t), 7) + 0.0 t, round(any_value(df), 5) + 0.0 df, round(1 - 2 * any_value(c * o) * sum(h * cos(o * u) ** (df - 1)), 6) + 0.0 p
FROM q, steps GROUP BY vertex, test"""
#: The three series of every supplier, as they are made above.
_SERIES = RP + """, f AS (SELECT s, CAST(t - 1 AS INTEGER) t, p1, p2, p3, p4, p5, p6 FROM rp)
, y AS (SELECT s, t, p1 + sin(CAST(t AS DOUBLE)) y0, p2 * 2 y1, p3 - CAST(t AS DOUBLE) / 10 y2 FROM f)"""


def _residuals(first: str) -> str:
    """``s7(s, t, y0, y1, y2)``: residuals of three series on six regressors, of which ``first`` is the first; each regressor
    in turn is taken out of all columns that follow it.
    """
    x, y = [f"x{i}" for i in range(1, 7)], ["y0", "y1", "y2"]
    sql = f"{_SERIES}\n, s0 AS (SELECT s, t, {first} x1, " + ", ".join(f"p{i} x{i}" for i in range(2, 7)) + ", y0, y1, y2 FROM f JOIN y USING (s, t))"
    sql += "\n, s1 AS (SELECT s, t, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY s) {c}" for c in x + y) + " FROM s0)"
    for k, q in enumerate(x, 1):
        rest = [f"{c} - {q} * sum({c} * {q}) OVER (PARTITION BY s) / sum({q} * {q}) OVER (PARTITION BY s) {c}" for c in x[k:] + y]
        sql += f"\n, s{k + 1} AS (SELECT s, t, " + ", ".join(rest) + f" FROM s{k})"
    return sql


def _least_squares() -> str:
    parts = [f"SELECT CAST(s AS VARCHAR) session_id, CAST({v} AS INTEGER) vertex, t, round(y{v}, 6) + 0.0 resid FROM s7" for v in range(3)]
    return f"WITH {_residuals('CAST(t % 5 AS DOUBLE)')}\n" + " UNION ALL ".join(parts)


#: A Fourier transform by its definition at the frequencies that count, tapered, padded, smoothed and summed.
_SPECTRUM = """fast AS (SELECT DISTINCT CAST(2**a * 3**b * 5**c AS BIGINT) z FROM (SELECT unnest(generate_series(0, 20)) a), (SELECT unnest(generate_series(0, 13)) b), (SELECT unnest(generate_series(0, 9)) c) WHERE 2**a * 3**b * 5**c < 1000000)
, n AS (SELECT s, n, CAST(floor(n * 0.1) AS BIGINT) m, (SELECT min(z) FROM fast WHERE z >= n) z FROM (SELECT s, count(*) n FROM y GROUP BY s))
, x AS (
  SELECT s, v, t, (y - avg(y) OVER (PARTITION BY s, v)) * CASE WHEN least(t, n - 1 - t) < m THEN 0.5 * (1 - cos(pi() * (2 * least(t, n - 1 - t) + 1) / (2 * m))) ELSE 1 END x
  FROM v JOIN n USING (s))
, k AS (SELECT s, n, z, z // 2 top, unnest(generate_series(0, least(z // 2, CAST(floor(0.6 * z / 2) AS BIGINT) + 5))) k FROM n)
, trig AS (SELECT k.s, k.k, t, cos(2 * pi() * k.k * t / z) c, sin(2 * pi() * k.k * t / z) d FROM k JOIN y ON y.s = k.s)
, p AS (SELECT x.s, v, k, sum(x * c)**2 + sum(x * d)**2 p FROM x JOIN trig g ON g.s = x.s AND g.t = x.t GROUP BY x.s, v, k)
, o AS (SELECT s, v, k, CASE WHEN k = 0 THEN max(CASE WHEN k = 1 THEN p END) OVER (PARTITION BY s, v) ELSE p END p FROM p)
, w(j, a) AS (VALUES (-3, 1 / 32.0), (-2, 1 / 8.0), (-1, 7 / 32.0), (0, 1 / 4.0), (1, 7 / 32.0), (2, 1 / 8.0), (3, 1 / 32.0))
, u AS (
  SELECT k.s, o.v, sum(a * o.p) / any_value(k.n) / 0.5 / (1 - 5 / 8.0 * 0.1 * 2) q
  FROM k, w JOIN o ON o.s = k.s AND o.k = abs(k.k + j) WHERE k.k >= 1 AND 0.25 * (k.k - 1) / (top - 1) <= 0.15 GROUP BY k.s, o.v)"""
_LONG = "v AS (SELECT s, t, 0 v, y0 y FROM y UNION ALL SELECT s, t, 1, y1 FROM y UNION ALL SELECT s, t, 2, y2 FROM y)"
_NORM = f"""WITH {_SERIES}
, {_LONG}
, {_SPECTRUM}
SELECT CAST(s AS VARCHAR) session_id, round(sqrt(avg(q)), 6) + 0.0 norm FROM u GROUP BY s"""


def _filtered(name: str, source: str, sections: np.ndarray) -> str:
    """Recurrences of all sections, value after value: each section keeps two numbers, and what it gives is the next one's
    input; all start at rest on the first value.
    """
    n = len(sections)
    kept = [f"{c}{k}" for k in range(1, n + 1) for c in "pq"]
    step = f"SELECT f.*, wide[t + 2] - wide[1] x0 FROM {name} f JOIN {source} USING (s, v) WHERE t + 1 < len(wide)"
    new = []
    for k, (b0, _, b2, a1, a2) in enumerate(sections.tolist(), 1):
        step = f"SELECT *, {b0!r} * x{k - 1} + p{k} x{k} FROM ({step})"
        new += [f"{-a1!r} * x{k} + q{k}", f"{b2!r} * x{k - 1} - {a2!r} * x{k}"]
    return f"""{name}(s, v, t, y, {", ".join(kept)}) AS (
  SELECT s, v, 0, {", ".join(["CAST(0 AS DOUBLE)"] * (2 * n + 1))} FROM {source}
  UNION ALL SELECT s, v, t + 1, x{n}, {", ".join(new)} FROM ({step}))"""


def _smooth(fs: float) -> str:
    """``smooth(s, v, n, t, y)`` of ``v(s, t, v, y)`` on the filter's grid: values of so many samples are mirrored at either
    end, and the filter runs forth and back.
    """
    nyquist = signal.GRID_HZ / 2
    bands = (tuple(f / nyquist for f in band) for band in (signal.PASSBAND, signal.STOPBAND))
    sections = signal.butter_band(*signal.band_order(*bands, signal.RIPPLE, signal.LOSS))
    pad = int(signal.PAD * fs)
    return f"""l AS (SELECT s, v, count(*) n, least({pad}, count(*) - 1) m, list(y ORDER BY t) y FROM v GROUP BY s, v)
, w1 AS MATERIALIZED (SELECT s, v, n, m, list_concat(list_concat(list_reverse(y[2:m + 1]), y), list_reverse(y[n - m:n - 1])) wide FROM l)
, {_filtered("forth", "w1", sections)}
, w2 AS MATERIALIZED (SELECT s, v, list(y ORDER BY t DESC) wide FROM forth GROUP BY s, v)
, {_filtered("back", "w2", sections)}
, smooth AS (SELECT s, v, n, n + m - 1 - back.t t, back.y FROM back JOIN w1 USING (s, v) WHERE n + m - 1 - back.t BETWEEN 0 AND n - 1)"""


def _band_pass() -> str:
    return f"""WITH RECURSIVE {_SERIES}
, {_LONG}
, {_smooth(signal.GRID_HZ)}
SELECT CAST(s AS VARCHAR) session_id, CAST(v AS INTEGER) vertex, CAST(t AS INTEGER) t, round(y, 5) + 0.0 y FROM smooth"""


def _analytic(pad: int) -> str:
    """``analytic(s, v, t, re, im)`` of ``la(s, v, n, y[])``: so many values are mirrored at either end; the imaginary part is
    a sum with the kernel that dropping the negative frequencies of n values amounts to.
    """
    return f"""wa AS (SELECT s, v, n, n + {2 * pad} z, y, list_concat(list_concat(list_reverse(y[1:{pad}]), y), list_reverse(y[n - {pad - 1}:n])) wide FROM la)
, ka AS (
  SELECT z, list(CASE WHEN d = 0 THEN 0.0
    WHEN z % 2 = 0 THEN (1 - cos(pi() * d)) * cos(pi() * d / z) / sin(pi() * d / z) / z
    ELSE (cos(pi() * d / z) - cos(pi() * d)) / sin(pi() * d / z) / z END ORDER BY d DESC) k
  FROM (SELECT z, unnest(generate_series(1 - z, z - 1)) d FROM (SELECT DISTINCT z FROM wa)) GROUP BY z)
, ta AS (SELECT wa.*, unnest(generate_series(0, n - 1)) t FROM wa)
, analytic AS (
  SELECT s, v, t, y[t + 1] re, list_dot_product(wide, k[ta.z - t - {pad}:2 * ta.z - t - {pad + 1}]) im FROM ta JOIN ka ON ka.z = ta.z)"""


_ANALYTIC = f"""WITH {_SERIES}
, {_LONG}
, la AS (SELECT s, v, count(*) n, list(y ORDER BY t) y FROM v GROUP BY s, v)
, {_analytic(5)}
SELECT CAST(s AS VARCHAR) session_id, CAST(v AS INTEGER) vertex, CAST(t AS INTEGER) t, round(re, 5) + 0.0 re, round(im, 5) + 0.0 im FROM analytic"""


def _preprocess() -> str:
    """Residuals, their norm, the band-pass on the filter's grid (which is the series' own), twice as many values by a
    filter over values with zeros between them, and the analytic signal.  Parameters are not negative, so their moduli add
    no regressors.
    """
    taps = signal.resampling_filter(2, 1).tolist()
    half = len(taps) // 2
    return f"""WITH RECURSIVE {_residuals("p1")}
, v AS MATERIALIZED (SELECT s, t, 0 v, y0 y FROM s7 UNION ALL SELECT s, t, 2, y2 FROM s7)
, {_SPECTRUM}
, norm AS MATERIALIZED (SELECT s, sqrt(avg(q)) norm FROM u GROUP BY s)
, {_smooth(1.0)}
, between AS (SELECT s, v, n, list_concat(list_concat(list_resize(CAST([] AS DOUBLE[]), {half}, CAST(0 AS DOUBLE)), flatten(list([y, 0] ORDER BY t))), list_resize(CAST([] AS DOUBLE[]), {half}, CAST(0 AS DOUBLE))) x FROM smooth GROUP BY s, v, n)
, up AS (SELECT s, v, n, unnest(generate_series(0, 2 * n - 1)) t, x FROM between)
, la AS MATERIALIZED (SELECT s, v, 2 * n n, list(list_dot_product(x[t + 1:t + {len(taps)}], CAST({taps} AS DOUBLE[])) ORDER BY t) y FROM up GROUP BY s, v, n)
, {_analytic(10)}
SELECT CAST(s AS VARCHAR) session_id, CAST(t AS INTEGER) t, round(re / norm, 5) + 0.0 re0, round(im / norm, 5) + 0.0 im0, 2 n
FROM analytic JOIN norm USING (s) WHERE v = 0"""


QUERIES = {
    "wilcoxon_w": (wilcoxon_w, f"WITH {EVENTS}{_RANKS} SELECT vertex, w, n0, n1, ties FROM w"),
    "wilcoxon_p": (wilcoxon_p, _WILCOXON_P),
    "signed_rank": (signed_rank, f"WITH {_PAIRS}, d AS (SELECT vertex, v1 - v2 d FROM p WHERE v1 <> v2), r AS (SELECT vertex, d, CAST(rank() OVER (PARTITION BY vertex ORDER BY abs(d)) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY vertex, abs(d)) AS DOUBLE) - 1) / 2 rk, CAST(count(*) OVER (PARTITION BY vertex, abs(d)) AS DOUBLE) t FROM d) SELECT vertex, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) v, count(*) n, sum(t * t - 1) ties FROM r GROUP BY vertex"),
    "welch": (welch, f"WITH {EVENTS}, s AS (SELECT event_type vertex, avg(floor(value)) FILTER (g = 0) m0, avg(floor(value)) FILTER (g = 1) m1, var_samp(floor(value)) FILTER (g = 0) / count(*) FILTER (g = 0) a, var_samp(floor(value)) FILTER (g = 1) / count(*) FILTER (g = 1) b, count(*) FILTER (g = 0) n0, count(*) FILTER (g = 1) n1 FROM e GROUP BY 1) SELECT vertex, round((m0 - m1) / sqrt(a + b), 7) + 0.0 t, round((a + b)**2 / (a * a / (n0 - 1) + b * b / (n1 - 1)), 5) df FROM s"),
    "paired_t": (paired_t, f"WITH {_PAIRS} SELECT vertex, round(avg(v1 - v2) / (stddev_samp(v1 - v2) / sqrt(count(*))), 7) + 0.0 t, CAST(count(*) - 1 AS DOUBLE) df FROM p GROUP BY vertex"),
    "t_tests": (t_tests, _T_P),
    "contrast_means": (contrast_means, f"WITH {EVENTS}, k AS (" + " UNION ALL ".join(f"SELECT '{n}' contrast, CASE WHEN {a} THEN 0 WHEN {b} THEN 1 END side, value FROM e" for n, a, b in CONTRASTS) + ") SELECT contrast, round(avg(value) FILTER (side = 0) - avg(value) FILTER (side = 1), 9) + 0.0 diff, count(*) n FROM k WHERE side IS NOT NULL GROUP BY contrast"),
    "permuted_labels": (permuted_labels, "WITH " + EVENTS + _perm("user_id", "g", 3) + " SELECT sim, subject, g FROM k"),
    "perm_p": (perm_p, "WITH " + EVENTS + _perm("user_id", "g", SHUFFLES) + _PVALUE),
    "perm_p_paired": (
        perm_p_paired,
        "WITH " + EVENTS + _perm("user_id * 2 + CASE WHEN visit = 'V2' THEN 1 ELSE 0 END", "CASE WHEN visit = 'V2' THEN 1 ELSE 0 END", SHUFFLES) + _PVALUE,
    ),
    "neighbors": (neighbors, f"WITH {_MESH} SELECT src, count(*) n, min(dst) least, max(dst) most FROM n GROUP BY src"),
    "neighbor_lists": (neighbor_lists, f"WITH {_MESH} SELECT src vertex, count(*) n, md5(string_agg(dst, ',' ORDER BY dst)) digest FROM n GROUP BY src"),
    "components": (components, f"WITH RECURSIVE {_COMP} SELECT * FROM o"),
    "max_cluster_null": (max_cluster_null, f"WITH RECURSIVE {_CLUSTERS} SELECT sim, max_size, limit95 FROM y, lim"),
    "cluster_report": (
        cluster_report,
        f"""WITH RECURSIVE {_CLUSTERS}
SELECT CASE WHEN c < 32 THEN 'lh' ELSE 'rh' END hemi, count(*) n_clusters, max(m) largest, round(any_value(limit95), 6) + 0.0 limit95, count(*) FILTER (m > limit95) n_over
FROM z, lim WHERE sim = 0 AND m >= {LEAST} GROUP BY 1""",
    ),
    "ols_resid": (ols_resid, f"WITH {EVENTS}, x AS (SELECT event_id, user_id, value, CAST(event_id % 97 AS DOUBLE) x FROM e), s AS (SELECT user_id, regr_slope(value, x) b, regr_intercept(value, x) a FROM x GROUP BY user_id) SELECT event_id, round(value - a - b * x, 6) + 0.0 resid FROM x JOIN s USING (user_id)"),
    "nuisance_resid": (nuisance_resid, _least_squares()),
    "psd_norm": (psd_norm, _NORM),
    "band_pass": (band_pass, _band_pass()),
    "analytic_signal": (analytic_signal, _ANALYTIC),
    "preprocess": (preprocess, _preprocess()),
    "cpca_exact": (cpca_exact, solver_sql.exact(K)),
    "cpca_dual": (cpca_dual, solver_sql.exact(K)),
    "cpca_tree": (cpca_tree, solver_sql.exact(K, singular=True)),
    "cpca_rsvd": (cpca_rsvd, solver_sql.randomised(K)),
    "cpca_pim": (cpca_pim, solver_sql.pim(K, START_ROWS, 4, BETA)),
    "cpca_pimvr": (cpca_pimvr, solver_sql.pimvr(K, START_ROWS, 2, 3, BETA)),
    "cpca_oja": (cpca_oja, solver_sql.oja(K, RATES)),
    "cpca_restarts": (cpca_restarts, solver_sql.restarts(K, START_ROWS, 2, 3, BETA, 2)),
    "magnitude_experiment": (magnitude_experiment, solver_sql.magnitudes(K)),
    "solver_simulation": (solver_simulation, solver_sql.simulation(K, START_ROWS, 3, 1e-3, 5)),
}
