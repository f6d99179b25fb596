"""Scalar functions as column expressions, and their NumPy twins for the solvers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 for erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Acklam's rational approximation of the normal quantile.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_LOW = 0.02425


def _poly(cs, x):
    out = cs[0]
    for c in cs[1:]:
        out = out * x + c
    return out


def wilson_bound(won: Column, lost: Column, z: float, upper: bool) -> Column:
    """One end of the Wilson score interval."""
    n, zz = won + lost, F.lit(z * z)
    half = F.lit(z) / (n + zz) * F.sqrt(won * lost / n + zz / 4)
    mid = (won + zz / 2) / (n + zz)
    return mid + half if upper else mid - half


def wilson_interval(won: Column, lost: Column, z: float = 1.959964) -> Column:
    return F.struct(wilson_bound(won, lost, z, False).alias("lower"), wilson_bound(won, lost, z, True).alias("upper"))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) * F.lit(1 / math.sqrt(2 * math.pi))


def norm_cdf(x: Column) -> Column:
    a = F.abs(x) * F.lit(math.sqrt(0.5))
    t = 1 / (1 + F.lit(ERF_P) * a)
    erf = 1 - _poly([F.lit(c) for c in (*reversed(ERF_A), 0.0)], t) * F.exp(-a * a)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def norm_ppf(p: Column) -> Column:
    """Null outside of (0, 1)."""
    tail = lambda q: _poly([F.lit(c) for c in PPF_C], q) / _poly([F.lit(c) for c in (*PPF_D, 1.0)], q)
    q = p - 0.5
    r = q * q
    mid = _poly([F.lit(c) for c in PPF_A], r) * q / _poly([F.lit(c) for c in (*PPF_B, 1.0)], r)
    low, high = tail(F.sqrt(-2 * F.log(p))), -tail(F.sqrt(-2 * F.log(1 - p)))
    return F.when((p <= 0) | (p >= 1), None).when(p < PPF_LOW, low).when(p > 1 - PPF_LOW, high).otherwise(mid)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    return F.when(x > 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def logsumexp(x: Column) -> Column:
    """Of an array column."""
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def expected_score(ra: Column, rb: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (rb - ra) / F.lit(scale)))


def mov_multiplier(margin: Column, exponent: float = 1.0) -> Column:
    return F.pow(F.log1p(margin) / F.lit(math.log(2)), F.lit(exponent))


def keener_skew(x: Column) -> Column:
    return 0.5 + 0.5 * F.signum(x - 0.5) * F.sqrt(F.abs(2 * x - 1))


def bernoulli_kl(p: Column, q: Column) -> Column:
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    return part(p, q) + part(1 - p, 1 - q)


def glicko_g(phi: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * phi * phi / F.lit(math.pi**2))


def geometric_ratio(theta: Column, n: Column) -> Column:
    """``(1 - exp(-n theta)) / (1 - exp(-theta))``, without cancellation."""
    return F.expm1(-n * theta) / F.expm1(-theta)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def kelly_fraction(p: Column, b: Column) -> Column:
    """The share of wealth to stake at win probability p and net odds b."""
    return F.greatest((p * (b + 1) - 1) / b, F.lit(0.0))


def fractional_kelly(p: Column, b: Column, part: Column) -> Column:
    return part * kelly_fraction(p, b)


def closing_line_value(taken: Column, closing: Column) -> Column:
    return taken / closing - 1


# -- NumPy twins -------------------------------------------------------------------------------------------------------


def np_norm_pdf(x):
    return np.exp(-np.square(x) / 2) / math.sqrt(2 * math.pi)


def np_norm_cdf(x):
    x = np.asarray(x, float)
    a = np.abs(x) * math.sqrt(0.5)
    t = 1 / (1 + ERF_P * a)
    erf = 1 - _poly([*reversed(ERF_A), 0.0], t) * np.exp(-a * a)
    return np.where(x >= 0, (1 + erf) / 2, (1 - erf) / 2)


def np_norm_ppf(p):
    p = np.asarray(p, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = lambda q: _poly(PPF_C, q) / _poly((*PPF_D, 1.0), q)
        q = p - 0.5
        mid = _poly(PPF_A, q * q) * q / _poly((*PPF_B, 1.0), q * q)
        low, high = tail(np.sqrt(-2 * np.log(p))), -tail(np.sqrt(-2 * np.log1p(-p)))
    return np.where(p < PPF_LOW, low, np.where(p > 1 - PPF_LOW, high, mid))


def np_softmax(x):
    e = np.exp(x - np.max(x))
    return e / e.sum()


def bracketed_root(f, lo: float, hi: float, steps: int = 200, tolerance: float = 1e-15) -> float | None:
    """A root of ``f`` between two points of unlike sign by bisection; None without a change of sign."""
    a, b = f(lo), f(hi)
    if a == 0:
        return lo
    if b == 0:
        return hi
    if not (math.isfinite(a) and math.isfinite(b)) or (a > 0) == (b > 0):
        return None
    for _ in range(steps):
        mid = (lo + hi) / 2
        m = f(mid)
        if m == 0 or hi - lo < tolerance:
            return mid
        if (m > 0) == (a > 0):
            lo, a = mid, m
        else:
            hi = mid
    return (lo + hi) / 2
