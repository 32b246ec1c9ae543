"""Distribution tails as numpy functions and as vectorised column functions.

Incomplete gamma and beta functions by series and continued fractions, the
normal quantile by a rational start and two Newton steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_sf(z):
    """P(Z > z)."""
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def norm_cdf(z):
    return norm_sf(-np.asarray(z, float))


def norm_ppf(p):
    """Normal quantile; -inf and inf at 0 and 1, NaN outside."""
    p = np.asarray(p, float)
    q = np.where(p > 0.5, 1 - p, p)
    with np.errstate(all="ignore"):
        t = np.sqrt(-2 * np.log(q))
        z = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
        for _ in range(3):
            e = norm_cdf(z) - q
            u = e * math.sqrt(2 * math.pi) * np.exp(z * z / 2)
            z = z - u / (1 + z * u / 2)
        z = np.where(p > 0.5, -z, z)
    z = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, z))
    return np.where((p < 0) | (p > 1) | np.isnan(p), np.nan, z)


def gamma_q(a, x):
    """Upper regularised incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    for i in np.ndindex(a.shape):
        s, v = float(a[i]), float(x[i])
        if not (s > 0) or math.isnan(v):
            out[i] = math.nan
        elif v <= 0:
            out[i] = 1.0
        elif v < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= v / n
                total += term
            out[i] = 1 - total * math.exp(-v + s * math.log(v) - math.lgamma(s))
        else:
            b = v + 1 - s
            c, d = 1e300, 1 / b
            h = d
            for k in range(1, 10_000):
                an = -k * (k - s)
                b += 2
                d = 1 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = math.exp(-v + s * math.log(v) - math.lgamma(s)) * h
    return out


def beta_i(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.zeros(a.shape)
    for i in np.ndindex(a.shape):
        p, q, v = float(a[i]), float(b[i]), float(x[i])
        if math.isnan(v) or p <= 0 or q <= 0:
            out[i] = math.nan
            continue
        if v <= 0 or v >= 1:
            out[i] = float(v >= 1)
            continue
        flip = v > (p + 1) / (p + q + 2)
        if flip:
            p, q, v = q, p, 1 - v
        front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(v) + q * math.log(1 - v)) / p
        c, d = 1.0, 1 / (1 - (p + q) * v / (p + 1) or 1e-300)
        h = d
        for m in range(1, 10_000):
            n = m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m))
            d = 1 / (1 + n * d or 1e-300)
            c = 1 + n / c or 1e-300
            h *= d * c
            n = -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 / (1 + n * d or 1e-300)
            c = 1 + n / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        out[i] = 1 - front * h if flip else front * h
    return out


def chi2_sf(x, df):
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def t_sf(t, df):
    """P(T > t)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    half = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, half, 1 - half)


def f_sf(f, df1, df2):
    f = np.asarray(f, float)
    return beta_i(np.asarray(df2, float) / 2, np.asarray(df1, float) / 2, df2 / (df2 + df1 * f))


def poisson_sf(k, mean):
    """P(X >= k)."""
    k = np.asarray(k, float)
    return np.where(k <= 0, 1.0, 1 - gamma_q(np.maximum(k, 1), mean))


def hypergeom_sf(total, marked, drawn, k):
    """P(X >= k) for the marked ones among ``drawn`` of ``total``."""
    out = []
    for t, m, d, x in np.broadcast(np.asarray(total), np.asarray(marked), np.asarray(drawn), np.asarray(k)):
        t, m, d, x = int(t), int(m), int(d), int(x)
        lo, hi = max(x, 0, d - (t - m)), min(m, d)
        pick = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
        out.append(min(1.0, math.fsum(math.exp(pick(m, i) + pick(t - m, d - i) - pick(t, d)) for i in range(lo, hi + 1))))
    return np.array(out)


def hypergeom_cdf(total, marked, drawn, k):
    """P(X <= k)."""
    return np.array([max(0.0, 1 - v) for v in np.atleast_1d(hypergeom_sf(total, marked, drawn, np.asarray(k) + 1))])


def hwe_exact(aa: int, ab: int, bb: int) -> float:
    """Exact Hardy-Weinberg p: the chance of heterozygote counts no likelier than the seen one, given the alleles."""
    n, rare = aa + ab + bb, 2 * min(aa, bb) + ab
    lp = lambda het: math.lgamma(n + 1) - math.lgamma((rare - het) / 2 + 1) - math.lgamma(het + 1) - math.lgamma(n - (rare + het) / 2 + 1) + het * math.log(2)
    every = [lp(h) for h in range(rare % 2, rare + 1, 2)]
    top = max(every)
    weights = [math.exp(v - top) for v in every]
    seen = math.exp(lp(ab) - top)
    return min(1.0, math.fsum(w for w in weights if w <= seen * (1 + 1e-9)) / math.fsum(weights))


def _column(fn: Callable) -> Callable[..., Column]:
    @pandas_udf(T.DoubleType())
    def one(a: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(float)))

    @pandas_udf(T.DoubleType())
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(float), b.to_numpy(float)))

    @pandas_udf(T.DoubleType())
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float)))

    @pandas_udf(T.DoubleType())
    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(), b.to_numpy(), c.to_numpy(), d.to_numpy()))

    by_number = {1: one, 2: two, 3: three, 4: four}

    def column(*args) -> Column:
        return by_number[len(args)](*[a if isinstance(a, Column) else F.lit(a) if not isinstance(a, str) else F.col(a) for a in args])

    return column


normal_upper, normal_quantile = _column(norm_sf), _column(norm_ppf)
chisq_upper, t_upper, f_upper = _column(chi2_sf), _column(t_sf), _column(f_sf)
poisson_upper, hypergeom_upper, hypergeom_lower = _column(poisson_sf), _column(hypergeom_sf), _column(hypergeom_cdf)
