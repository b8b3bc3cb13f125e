"""Distribution tails for small result tables (one row per group), as vectorised pandas UDFs.

Spark has no normal, t or binomial tail function, nor the exact distributions of rank and sign-flip statistics. These run on aggregated tables only.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def _finite(*xs) -> bool:
    return all(x is not None and not pd.isna(x) for x in xs)


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal."""
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)) if _finite(v) else None).astype("float64")


@F.pandas_udf(DoubleType())
def normal_isf(p: pd.Series) -> pd.Series:
    """Inverse of the upper tail; p of exactly 0 or 1 gives an infinite value, as in the definition."""
    def f(v):
        if not _finite(v):
            return None
        if v <= 0.0:
            return math.inf
        if v >= 1.0:
            return -math.inf
        return -_NORMAL.inv_cdf(v)
    return p.map(f).astype("float64")


def _stirling_rest(z: float) -> float:
    # log gamma less its Stirling form
    if z >= 15.0:
        return (1.0 / 12.0 - (1.0 / 360.0 - 1.0 / (1260.0 * z * z)) / (z * z)) / z
    return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2.0 * math.pi))


def _binom_two_sided(k: int, n: int) -> float:
    # at p = 1/2 the distribution is symmetric: the two-sided p is twice the smaller tail, an incomplete beta at 1/2
    m = min(k, n - k)
    if 2 * m == n:
        return 1.0
    a, b = float(n - m), m + 1.0
    s, u = a + b, (a - b) / (a + b)
    log_front = (0.5 * math.log(a / s * b / (2.0 * math.pi)) - a * math.log1p(u) - b * math.log1p(-u)
                 + _stirling_rest(s) - _stirling_rest(a) - _stirling_rest(b))
    return min(1.0, 2.0 * math.exp(log_front) * _betacf(a, b, 0.5) / a)


@F.pandas_udf(DoubleType())
def binom_two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
    """Exact two-sided sign-test p for any n."""
    def f(kk, nn):
        return _binom_two_sided(int(kk), int(nn)) if _finite(kk, nn) and nn > 0 else None
    return pd.Series([f(a, b) for a, b in zip(k, n)], dtype="float64")


def _betacf(a: float, b: float, x: float) -> float:
    # continued fraction of the incomplete beta function (modified Lentz evaluation)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500 + int(10.0 * math.sqrt(max(a, b)))):      # near the mean it takes about the root of the larger one
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for num in (even, odd):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) if 0.0 < x < 1.0 else 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        inc = front * _betacf(a, b, x) / a
    else:
        inc = 1.0 - front * _betacf(b, a, 1.0 - x) / b
    return 1.0 - inc / 2.0 if t >= 0 else inc / 2.0


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """Student t quantile by bisection on the exact distribution function."""
    def f(pp, dd):
        if not _finite(pp, dd) or dd <= 0:
            return None
        lo, hi = -1.0, 1.0
        while _t_cdf(hi, dd) < pp:
            hi *= 2.0
        while _t_cdf(lo, dd) > pp:
            lo *= 2.0
        for _ in range(200):
            mid = (lo + hi) / 2.0
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if _t_cdf(mid, dd) < pp else (lo, mid)
        return (lo + hi) / 2.0
    return pd.Series([f(a, b) for a, b in zip(p, df)], dtype="float64")


def u_counts(m: int, n: int) -> np.ndarray:
    """Number of ways in which ``m`` of m + n distinct values take each value of U (0 to m n), exact: partitions into at most m parts, built part by
    part, less those with a part above n. Whole numbers of 64 bits while all of them fit, of any length beyond."""
    m, n = min(m, n), max(m, n)
    size = m * n + 1
    c = np.zeros(size, np.int64 if math.comb(m + n, m) < 1 << 62 else object)
    c[0] = 1
    for i in range(1, m + 1):
        if n + i < size:
            c[n + i:] -= c[:size - n - i].copy()            # times 1 - q^(n + i)
        for r in range(min(i, size)):                       # over 1 - q^i: running sums at stride i
            c[r::i] = np.add.accumulate(c[r::i])
    return c


def _u_tail(m: int, n: int, u: float, greater: bool) -> float:
    c = u_counts(m, n)
    return float(int(c[math.ceil(u):].sum() if greater else c[:math.floor(u) + 1].sum()) / math.comb(m + n, m))


def exact_u(greater: bool):
    """Column function (n_a, n_b, u) of the exact one-sided p of U without ties."""
    @F.pandas_udf(DoubleType())
    def tail(a: pd.Series, b: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([_u_tail(int(x), int(y), float(z), greater) if _finite(x, y, z) and x > 0 and y > 0 else None for x, y, z in zip(a, b, u)], dtype="float64")
    return tail


def _signed_sums(v: np.ndarray) -> np.ndarray:
    sums = np.zeros(1)
    for x in v:
        sums = np.concatenate([sums - x, sums + x])
    return sums


def _flip_p(values) -> float:
    v = np.sort(np.asarray(values, np.float64))
    wanted = abs(math.fsum(v)) - 1e-12 * len(v)
    if wanted <= 0:
        return 1.0
    # the signed sums of both halves; for each of one, those of the other that reach the total on either side
    left, right = _signed_sums(v[::2]), np.sort(_signed_sums(v[1::2]))
    above = len(right) * len(left) - int(np.searchsorted(right, wanted - left, "left").sum())
    below = int(np.searchsorted(right, -wanted - left, "right").sum())
    return (above + below) / 2.0 ** len(v)


@F.pandas_udf(DoubleType())
def signflip_halves(values: pd.Series) -> pd.Series:
    """Exact two-sided sign-flip p of an array of differences by meeting in the middle: 2^(n/2) sums instead of 2^n."""
    return pd.Series([None if v is None else _flip_p(v) for v in values], dtype="float64")
