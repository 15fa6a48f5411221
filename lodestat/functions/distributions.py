"""Tails and quantiles of distributions, by the mathematics library that Spark ships.

Tails are computed directly, never as one minus the other side, so that tiny ones survive.
Quantiles of t, beta and chi-squared are found on the driver for scalars, or vectorised by bisection.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_MATH = "org.apache.commons.math3"


def _call(cls: str, method: str, *args: Column) -> Column:
    return F.java_method(F.lit(f"{_MATH}.{cls}"), F.lit(method), *[a.cast("double") for a in args]).cast("double")


def _guard(value: Column, *args: Column) -> Column:
    known = F.lit(True)
    for a in args:
        known = known & a.isNotNull() & ~F.isnan(a.cast("double"))
    return F.when(known, value)


def _filled(c: Column, by: float = 1.0) -> Column:
    return F.coalesce(c.cast("double"), F.lit(by))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|)."""
    x, n = _filled(t), _filled(df)
    return _guard(_call("special.Beta", "regularizedBeta", n / (n + x * x), n / 2, F.lit(0.5)), t, df)


def t_tail(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    """The p value of t for an alternative: two-sided, greater or less."""
    both = t_two_sided(t, df)
    if alternative == "two-sided":
        return both
    if alternative not in ("greater", "less"):
        raise ValueError(alternative)
    toward = t >= 0 if alternative == "greater" else t <= 0
    return F.when(toward, both / 2).otherwise(1 - both / 2)


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """P(F >= f)."""
    x, a, b = _filled(f), _filled(d1), _filled(d2)
    return _guard(_call("special.Beta", "regularizedBeta", b / (b + a * x), b / 2, a / 2), f, d1, d2)


def chi2_upper(x: Column, df: Column) -> Column:
    """P(X >= x) of chi-squared."""
    return _guard(_call("special.Gamma", "regularizedGammaQ", _filled(df) / 2, _filled(x) / 2), x, df)


def norm_cdf(z: Column) -> Column:
    return _guard(_call("special.Erf", "erfc", -_filled(z) / math.sqrt(2)) / 2, z)


def norm_upper(z: Column) -> Column:
    return _guard(_call("special.Erf", "erfc", _filled(z) / math.sqrt(2)) / 2, z)


def norm_ppf(p: Column) -> Column:
    return _guard(_call("special.Erf", "erfInv", 2 * _filled(p, 0.5) - 1) * math.sqrt(2), p)


def quantile(spark: SparkSession, kind: str, p: float, *args: float) -> float:
    """A quantile of ``t``, ``beta``, ``chi2`` or ``norm``, on the driver."""
    names = {"t": "TDistribution", "beta": "BetaDistribution", "chi2": "ChiSquaredDistribution", "norm": "NormalDistribution", "f": "FDistribution"}
    cls = getattr(spark._jvm.org.apache.commons.math3.distribution, names[kind])
    return float(cls(*[float(a) for a in args]).inverseCumulativeProbability(float(p)))


# The same functions for scalars, for use inside of grouped functions.


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h if flip else front * h


def t_two_sided_np(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=10_000)
def t_ppf(p: float, df: float) -> float:
    """The quantile of t, by bisection."""
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_two_sided_np(hi, df) / 2 > 1 - p:
        hi *= 2
    while hi - lo > 1e-15 * hi:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_two_sided_np(mid, df) / 2 > 1 - p else (lo, mid)
    return (lo + hi) / 2


def beta_ppf(p: float, a: float, b: float) -> float:
    """The quantile of beta, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_inc(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def norm_cdf_np(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def norm_ppf_np(p: float) -> float:
    """The quantile of the normal distribution, by bisection on the upper tail."""
    if p < 0.5:
        return -norm_ppf_np(1 - p)
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if math.erfc(mid / math.sqrt(2)) / 2 > 1 - p else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, error: float = 0.05) -> tuple[float, float]:
    """The exact interval of a Monte Carlo count."""
    low = 0.0 if k == 0 else beta_ppf(error / 2, k, n - k + 1)
    high = 1.0 if k == n else beta_ppf(1 - error / 2, k + 1, n - k)
    return low, high


def noncentral_t_power(effect: float, df: float, alpha: float = 0.05) -> float:
    """P(|T'| > t crit) of noncentral t, by integrating the normal over the chi distribution."""
    crit = t_ppf(1 - alpha / 2, df)
    grid = np.linspace(1e-9, 1 + 12 / math.sqrt(2 * df), 4001)  # chi / sqrt(df)
    log = (df - 1) * np.log(grid) - df * grid**2 / 2 + math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2)
    erfc = np.vectorize(math.erfc, otypes=[float])
    upper = erfc((crit * grid - effect) / math.sqrt(2)) / 2
    lower = erfc((crit * grid + effect) / math.sqrt(2)) / 2
    return float(np.trapezoid(np.exp(log) * (upper + lower), grid))


def minimum_effect(df: float, n_scale: float, power: float = 0.8, alpha: float = 0.05) -> float:
    """The smallest standardised effect found with the given power: its noncentrality is effect times ``n_scale``."""
    lo, hi = 0.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if noncentral_t_power(mid * n_scale, df, alpha) < power else (lo, mid)
    return (lo + hi) / 2
