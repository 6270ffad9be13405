"""Distribution functions that Spark has no expression for, as Arrow-batched UDFs over numpy and math kernels."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def erfc(x) -> np.ndarray:
    """Complementary error function: the series of its complement up to 2, its continued fraction beyond."""
    x = np.asarray(x, np.float64)
    y = np.abs(x)
    near, far = np.minimum(y, 2.0), np.maximum(y, 2.0)
    term = total = near
    for k in range(1, 60):
        term = term * 2 * near * near / (2 * k + 1)
        total = total + term
    down = far
    for k in range(120, 0, -1):
        down = far + k / 2 / down
    scale = 1 / math.sqrt(math.pi)
    out = np.where(y < 2, 1 - 2 * scale * np.exp(-near * near) * total, scale * np.exp(-far * far) / down)
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 2 - out, out))


def normal_two_sided(z) -> np.ndarray:
    return erfc(np.abs(z) / math.sqrt(2))


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = (np.asarray(v, np.float64) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inner = (y > 0) & (y < 1)
    z = np.where(inner, y, 0.5)
    front = np.exp(np.asarray(_lgamma(a + b) - _lgamma(a) - _lgamma(b), np.float64) + a * np.log(z) + b * np.log1p(-z)) / a
    tiny = 1e-300

    def kept(v):
        return np.where(np.abs(v) > tiny, v, tiny)

    c, d = np.ones_like(z), 1 / kept(1 - (a + b) * z / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / kept(1 + num * d)
            c = kept(1 + num / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    part = np.where(y >= 1, 1.0, np.where(inner, front * h, 0.0))
    return np.where(np.isnan(x), np.nan, np.where(turn, 1 - part, part))


def t_two_sided(t, df) -> np.ndarray:
    t, df = (np.asarray(v, np.float64) for v in np.broadcast_arrays(t, df))
    good = ~np.isnan(t) & (df > 0)
    d = np.where(good, df, 1.0)
    return np.where(good, beta_inc(d / 2, 0.5, d / (d + np.where(good, t, 0.0) ** 2)), np.nan)


@lru_cache(256)
def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """Number of ways to each value 0..m*n of the rank-sum statistic without ties."""
    ways = np.zeros((m + 1, m * n + 1))
    ways[0, 0] = 1
    for rank in range(1, m + n + 1):
        for k in range(min(rank, m), 0, -1):
            shift = rank - k  # the k-th smallest chosen rank stands this far above its least place
            if shift <= n:
                ways[k, shift:] += ways[k - 1, : m * n + 1 - shift]
    return ways[m]


@lru_cache(256)
def signed_rank_counts(n: int) -> np.ndarray:
    """Number of ways to each value 0..n(n+1)/2 of the signed-rank statistic without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    return ways


@lru_cache(256)
def _two_sided(kind: str, *sizes: int) -> np.ndarray:
    """Exact p of each value of a statistic whose distribution is symmetric."""
    ways = rank_sum_counts(*sizes) if kind == "rank sum" else signed_rank_counts(*sizes)
    below = np.cumsum(ways) / ways.sum()
    return np.minimum(1.0, 2 * np.minimum(below, below[::-1]))


def _corrected(off, variance) -> np.ndarray:
    """Standardised distance from the mean, half a step nearer to it; NaN without variance."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(variance > 0, np.abs(np.abs(off) - 0.5 * (off != 0)) / np.sqrt(variance), np.nan)


def _rank_sum_z(w, m, n, ties) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return _corrected(w - m * n / 2, m * n / 12 * (m + n + 1 - ties / ((m + n) * (m + n - 1))))


def rank_sum_two_sided(w, m, n, ties=0.0) -> np.ndarray:
    """p of the rank-sum statistic: exact below 50 per group without ties, else normal with continuity correction.

    ``ties``: sum of t^3 - t over groups of tied values.
    """
    w, m, n, ties = (np.atleast_1d(np.asarray(v, np.float64)) for v in np.broadcast_arrays(w, m, n, ties))
    good = ~np.isnan(w) & (m >= 1) & (n >= 1)
    exact = good & (m < 50) & (n < 50) & (ties == 0)
    out = np.where(good, np.minimum(1.0, normal_two_sided(_rank_sum_z(w, m, n, ties))), np.nan)
    for a, b in set(zip(m[exact].tolist(), n[exact].tolist())):
        here = exact & (m == a) & (n == b)
        out[here] = _two_sided("rank sum", int(a), int(b))[w[here].astype(int)]
    return out


def rank_sum_below(w: np.ndarray, m: np.ndarray, n: np.ndarray, ties: np.ndarray, alpha: float) -> np.ndarray:
    """Whether :func:`rank_sum_two_sided` is below ``alpha``: the normal case by one quantile, without a p for each."""
    exact = (m < 50) & (n < 50) & (ties == 0) & (m >= 1) & (n >= 1)
    with np.errstate(invalid="ignore"):
        out = ~exact & (m >= 1) & (n >= 1) & (_rank_sum_z(w, m, n, ties) > NormalDist().inv_cdf(1 - alpha / 2))
    if exact.any():
        out[exact] = rank_sum_two_sided(w[exact], m[exact], n[exact]) < alpha
    return out


def signed_rank_two_sided(v, n, ties=0.0, zeros=0) -> np.ndarray:
    """p of the signed-rank statistic: exact below 50 differences without ties and zeros, else normal with continuity
    correction; ``n`` without the ``zeros``.
    """
    v, n, ties, zeros = (np.atleast_1d(np.asarray(x, np.float64)) for x in np.broadcast_arrays(v, n, ties, zeros))
    good = ~np.isnan(v) & (n >= 1)
    exact = good & (n < 50) & (ties == 0) & (zeros == 0)
    z = _corrected(v - n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    out = np.where(good, np.minimum(1.0, normal_two_sided(z)), np.nan)
    for a in set(n[exact].tolist()):
        here = exact & (n == a)
        out[here] = _two_sided("signed rank", int(a))[v[here].astype(int)]
    return out


def _udf(f):
    """A UDF over whole Arrow batches; null in any argument counts as NaN."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(f(*[c.to_numpy(np.float64, na_value=np.nan) for c in columns]), dtype="float64")

    return F.pandas_udf(_ARITY[f.__code__.co_argcount](run), "double")


#: Spark reads the number of arguments from the function.
_ARITY = {
    1: lambda run: lambda a: run(a),
    2: lambda run: lambda a, b: run(a, b),
    4: lambda run: lambda a, b, c, d: run(a, b, c, d),
}


def normal_p(z):
    return _udf(normal_two_sided)(z)


def t_p(t, df):
    return _udf(t_two_sided)(t, df)


def rank_sum_p(w, m, n, ties):
    return _udf(rank_sum_two_sided)(w, m, n, ties)


def signed_rank_p(v, n, ties, zeros):
    return _udf(signed_rank_two_sided)(v, n, ties, zeros)
