"""Statistics of complex matrices in long form ``(session_id, t, v, re, im)`` or in rows of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cplx
from . import linalg
from .quantiles import quantiles

#: Numbers of loadings that are broadcast.
LOADINGS = 2_000_000
#: Labels of the medial wall (fixed values of the atlas).
MEDIAL_WALL = ("unknown", "corpuscallosum")


def explode_obs(obs: DataFrame) -> DataFrame:
    """``(session_id, t, re[], im[])`` -> ``(session_id, t, v, re, im)``."""
    return obs.select("session_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("v", "z")).select("session_id", "t", "v", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def column_stats(x: DataFrame, *by: str) -> DataFrame:
    """Complex mean and variance of each variable."""
    re, im = cplx.mean()
    return x.groupBy(*by, "v").agg(re.alias("mean_re"), im.alias("mean_im"), cplx.variance().alias("var"))


def total_variance(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("var").alias("total_var"))


def center_scale(x: DataFrame, least: float = 1e-9) -> DataFrame:
    """Centred variables, divided by their deviation where the variance is over ``least``."""
    stats = column_stats(x)
    sd = F.when(F.col("var") > least, F.sqrt("var")).otherwise(F.lit(1.0))
    return x.join(stats, "v").select("session_id", "t", "v", ((F.col("re") - F.col("mean_re")) / sd).alias("re"), ((F.col("im") - F.col("mean_im")) / sd).alias("im"))


def constant_columns(x: DataFrame) -> DataFrame:
    """Variables that are constant in every session."""
    by_session = x.groupBy("session_id", "v").agg((F.coalesce(cplx.variance(), F.lit(0.0)) == 0).alias("constant"))
    return by_session.groupBy("v").agg(F.bool_and("constant").alias("always"), F.count("*").alias("n_sessions")).where("always").select("v", "n_sessions")


def drop_constant(x: DataFrame) -> DataFrame:
    return x.join(constant_columns(x).select("v"), "v", "left_anti")


def scatter_full(values: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Compact values on the whole dimension; null where there is none."""
    return dimension.select(key).join(values, key, "left")


def cortex(atlas: DataFrame, outside: tuple[str, ...] = MEDIAL_WALL) -> DataFrame:
    """Vertices outside the medial wall."""
    return atlas.where(~F.col("label").isin(*outside))


def magnitudes(x: DataFrame, *by: str) -> DataFrame:
    """Mean, median and upper quantiles of moduli over all cells of each group."""
    found = quantiles(x.select(*by, cplx.mod().alias("m")), by, "m", [0.5, 0.75, 0.9])
    return found.select(*by, F.col("mean").alias("mean_mod"), *[F.col("q")[i].alias(n) for i, n in enumerate(("median_mod", "q75_mod", "q90_mod"))])


def magnitude_medians(x: DataFrame, *by: str) -> DataFrame:
    """Medians over variables of each variable's mean, median and upper quantiles."""
    names = ("mean_mod", "median_mod", "q75_mod", "q90_mod")
    inner = magnitudes(x, *by, "v")
    long = inner.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("m")) for n in names])).alias("_s"))
    medians = quantiles(long.select(*by, F.col("_s.n").alias("_name"), F.col("_s.m").alias("m")), [*by, "_name"], "m", [0.5])
    return medians.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("q")[0])).alias(f"med_{n}") for n in names])


def gram(x: DataFrame) -> DataFrame:
    """``i, j, re, im`` of sum over t of conj(x_i) x_j, by a join on t: the reference form for few variables.

    Half of it is computed and mirrored; for many variables use ``linalg.gram_times``.
    """
    a = x.select("session_id", "t", F.col("v").alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = x.select("session_id", "t", F.col("v").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    half = a.join(b, ["session_id", "t"]).where("i <= j").groupBy("i", "j")
    half = half.agg(F.sum(F.expr("ar * br + ai * bi")).alias("re"), F.sum(F.expr("ar * bi - ai * br")).alias("im"))
    sides = F.when(F.expr("i = j"), F.array(F.struct("i", "j", "re", "im"))).otherwise(F.array(F.struct("i", "j", "re", "im"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("re"), (-F.col("im")).alias("im"))))
    return half.select(F.inline(sides))


def fixed_scores(x: DataFrame, w: DataFrame, *keep: str) -> DataFrame:
    """Scores ``sum over v of x_v w_v`` (no conjugate) of cells for loadings ``(v, pc, wr, wi)``, by a join; for rows of
    arrays use :func:`row_scores`, which moves nothing.
    """
    zr, zi = cplx.mul(("re", "im"), ("wr", "wi"))
    return x.join(w, "v").groupBy("session_id", "t", *keep, "pc").agg(F.sum(zr).alias("re"), F.sum(zi).alias("im"))


def row_scores(obs: DataFrame, w: DataFrame) -> DataFrame:
    """The same of rows ``(session_id, t, re[], im[])``: the loadings, one number for each variable and component, are
    broadcast if there are at most LOADINGS, else the cells are joined.  Variables without loadings count as 0.
    """
    rows = w.limit(LOADINGS + 1).collect()
    if len(rows) > LOADINGS:
        return fixed_scores(explode_obs(obs), w)
    matrix = np.zeros((1 + max((r["v"] for r in rows), default=-1), 1 + max((r["pc"] for r in rows), default=-1)), np.complex128)
    for r in rows:
        matrix[r["v"], r["pc"]] = complex(r["wr"], r["wi"])
    return linalg.scores(obs, matrix)


def explained_by(x: DataFrame, w: DataFrame, *by: str, standardize: str = "raw") -> DataFrame:
    """``by..., pc, r2``: shares of the variance of cells that loadings explain.

    ``standardize``: ``raw`` scores the cells as they are; ``fit`` centres and scales them first by all of them, as the
    matrix is on which loadings are fitted.
    """
    if standardize not in ("raw", "fit"):
        raise ValueError(f"cells are taken raw or as for a fit, not {standardize!r}")
    x = center_scale(x) if standardize == "fit" else x
    return explained(fixed_scores(x, w), x, *by)


def explained(scores: DataFrame, x: DataFrame, *by: str) -> DataFrame:
    """Variance of scores over the total variance of variables, for each group and component."""
    top = scores.groupBy(*by, "pc").agg(cplx.variance().alias("score_var"))
    total = column_stats(x, *by).groupBy(*by).agg(F.sum("var").alias("total_var"))
    met = top.join(total, list(by)) if by else top.crossJoin(F.broadcast(total))  # one row
    return met.select(*by, "pc", (F.col("score_var") / F.col("total_var")).alias("r2"))


def _covariance(a: tuple[str, str], b: tuple[str, str]) -> tuple[Column, Column]:
    """Aggregates: real and imaginary part of the mean of conj(a) b, both centred; kept centred while it is merged, so that
    its digits do not depend on how far the means are from 0.
    """
    (ar, ai), (br, bi) = a, b
    return F.covar_pop(ar, br) + F.covar_pop(ai, bi), F.covar_pop(ar, bi) - F.covar_pop(ai, br)


def posthoc_slope(y: DataFrame, z: DataFrame) -> DataFrame:
    """``v, pc, re, im``: complex least-squares slope of each variable on each score, both centred, joined on time."""
    a = z.select("session_id", "t", "pc", F.col("re").alias("zr"), F.col("im").alias("zi"))
    met = y.join(a, ["session_id", "t"])
    spread = F.var_pop("zr") + F.var_pop("zi")
    re, im = _covariance(("zr", "zi"), ("re", "im"))
    return met.groupBy("v", "pc").agg((re / spread).alias("re"), (im / spread).alias("im"))


def complex_correlation(pairs: DataFrame, *by: str) -> DataFrame:
    """Modulus of the complex correlation of ``(ar, ai)`` with ``(br, bi)``: the same whatever the phase of either."""
    re, im = _covariance(("ar", "ai"), ("br", "bi"))
    spread = F.sqrt((F.var_pop("ar") + F.var_pop("ai")) * (F.var_pop("br") + F.var_pop("bi")))
    return pairs.groupBy(*by).agg((F.sqrt(re * re + im * im) / spread).alias("mcc"))


def adjust_phase(x: DataFrame, phase: str, *by: str, steps: int = 360) -> DataFrame:
    """Offset of each group, on a grid of a turn, that makes the mean of wrapped phases smallest in absolute value, and
    the phases less it.  Ties go to the smallest offset.

    The sum of phases wrapped at an offset is their sum less the offsets, plus a turn for each phase below the offset: so
    the rows are counted by bin of the grid, and only the counts (``steps`` at most a group) meet the grid.
    """
    two_pi = 6.283185307179586
    turn = F.pmod(F.col(phase), F.lit(two_pi))
    near = F.floor(turn / (two_pi / steps)).cast("int")  # rounding may be off by one; the grid's own offsets decide
    up, down = (near + 1) * (two_pi / steps) <= turn, near * (two_pi / steps) > turn
    bins = x.where(F.col(phase).isNotNull()).groupBy(*by, F.when(up, near + 1).when(down, near - 1).otherwise(near).alias("bin"))
    bins = bins.agg(F.count("*").alias("n"), F.sum(turn).alias("sum"))
    told = bins.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    grid = told.select(*by, "bins", "n", "sum", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    below = F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(b["bin"] < F.col("step"), b["n"]).otherwise(F.lit(0)))
    mean = (F.col("sum") + below * two_pi) / F.col("n") - F.col("step") * (two_pi / steps) - two_pi / 2
    best = grid.select(*by, "step", F.round(F.abs(mean), 9).alias("cost")).groupBy(*by).agg(F.min_by("step", F.struct("cost", "step")).alias("step"))
    return x.join(best, list(by)).withColumn("adjusted", cplx.wrap(F.col(phase) - F.col("step") * (two_pi / steps)))
