"""Complex numbers as pairs of columns; every function is a native expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mod(re="re", im="im") -> Column:
    re, im = _c(re), _c(im)
    return F.sqrt(re * re + im * im)


def arg(re="re", im="im") -> Column:
    return F.atan2(_c(im), _c(re))


def mul(a: tuple, b: tuple) -> tuple[Column, Column]:
    (ar, ai), (br, bi) = map(lambda p: (_c(p[0]), _c(p[1])), (a, b))
    return ar * br - ai * bi, ar * bi + ai * br


def conj(z: tuple) -> tuple[Column, Column]:
    return _c(z[0]), -_c(z[1])


def mean(re="re", im="im") -> tuple[Column, Column]:
    """Aggregates: real and imaginary part of the mean."""
    return F.avg(_c(re)), F.avg(_c(im))


def variance(re="re", im="im") -> Column:
    """Aggregate: sum of squared distances to the mean over n - 1."""
    return F.var_samp(_c(re)) + F.var_samp(_c(im))


def wrap(x) -> Column:
    """To [-pi, pi): x modulo a full turn, less half a turn."""
    return F.pmod(_c(x), F.lit(2 * math.pi)) - math.pi


def signed_sqrt(x) -> Column:
    return F.signum(_c(x)) * F.sqrt(F.abs(_c(x)))
