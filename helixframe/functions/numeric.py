"""Numerical helpers: quadrature, root and minimum search, logistic transforms."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def trapezoid(f: Callable[[float], float], a: float, b: float, n: int = 1000) -> float:
    x = np.linspace(a, b, n + 1)
    y = np.array([f(v) for v in x])
    return float((b - a) / n * (y.sum() - 0.5 * (y[0] + y[-1])))


def simpson(f: Callable[[float], float], a: float, b: float, n: int = 1000) -> float:
    """Composite Simpson rule over an even number of parts."""
    n += n % 2
    y = np.array([f(v) for v in np.linspace(a, b, n + 1)])
    return float((b - a) / (3 * n) * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def boole(f: Callable[[float], float], a: float, b: float, n: int = 1000) -> float:
    n += -n % 4
    y = np.array([f(v) for v in np.linspace(a, b, n + 1)])
    w = np.array([14, 32, 12, 32] * (n // 4) + [7], float)
    w[0] = 7
    return float(2 * (b - a) / (45 * n) * (w * y).sum())


def gauss_legendre(f: Callable[[float], float], a: float, b: float, n: int = 32) -> float:
    x, w = np.polynomial.legendre.leggauss(n)
    return float((b - a) / 2 * sum(wi * f((b - a) / 2 * xi + (a + b) / 2) for xi, wi in zip(x, w)))


def adaptive_simpson(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-10) -> float:
    def part(a, fa, b, fb, m, fm, whole, tol, depth):
        l, r = (a + m) / 2, (m + b) / 2
        fl, fr = f(l), f(r)
        left, right = (m - a) / 6 * (fa + 4 * fl + fm), (b - m) / 6 * (fm + 4 * fr + fb)
        if depth <= 0 or abs(left + right - whole) <= 15 * tol:
            return left + right + (left + right - whole) / 15
        return part(a, fa, m, fm, l, fl, left, tol / 2, depth - 1) + part(m, fm, b, fb, r, fr, right, tol / 2, depth - 1)

    m = (a + b) / 2
    fa, fb, fm = f(a), f(b), f(m)
    return part(a, fa, b, fb, m, fm, (b - a) / 6 * (fa + 4 * fm + fb), tolerance, 40)


def bisect(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-12) -> float:
    """Root of a function of opposite signs at both ends."""
    fa = f(a)
    if fa * f(b) > 0:
        raise ValueError("no change of sign")
    while b - a > tolerance * max(1.0, abs(a), abs(b)):
        m = (a + b) / 2
        fm = f(m)
        if fa * fm <= 0:
            b = m
        else:
            a, fa = m, fm
    return (a + b) / 2


def newton(f: Callable[[float], float], df: Callable[[float], float], x: float, steps: int = 100, tolerance: float = 1e-12) -> float:
    for _ in range(steps):
        step = f(x) / df(x)
        x -= step
        if abs(step) <= tolerance * max(1.0, abs(x)):
            break
    return x


def golden_section(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-9) -> float:
    """Minimum of a unimodal function."""
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def minimise(f: Callable[[np.ndarray], float], x: np.ndarray, steps: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Minimum of a function of several variables by the downhill simplex method."""
    n = len(x)
    points = [np.array(x, float)] + [np.array(x, float) + (0.1 + 0.1 * abs(x[i])) * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        away = lambda t: centre + t * (points[-1] - centre)
        r = away(-1.0)
        fr = f(r)
        if fr < values[0]:
            e = away(-2.0)
            fe = f(e)
            points[-1], values[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = r, fr
        else:
            c = away(-0.5 if fr < values[-1] else 0.5)
            fc = f(c)
            if fc < min(fr, values[-1]):
                points[-1], values[-1] = c, fc
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def logit(p):
    p = np.asarray(p, float)
    return np.log(p / (1 - p))


def logistic(x):
    x = np.asarray(x, float)
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def logsumexp(x) -> float:
    x = np.asarray(x, float)
    top = x.max()
    return float(top + np.log(np.exp(x - top).sum())) if np.isfinite(top) else float(top)


def gamma_parameters(x) -> tuple[float, float]:
    """(shape, scale) by maximum likelihood: a closed start and Newton steps."""
    x = np.asarray(x, float)
    s = math.log(x.mean()) - np.log(x).mean()
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    digamma = lambda v: (math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5
    trigamma = lambda v: (digamma(v + 1e-4) - digamma(v - 1e-4)) / 2e-4
    for _ in range(20):
        k = max(1e-6, k - (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k)))
    return k, float(x.mean() / k)


def liu_tail(q: float, weights) -> float:
    """P(sum of w_i chi2_1 > q) by matching four moments to a non-central chi-square (central where it fits)."""
    from helixframe.functions.dist import chi2_sf, poisson_sf

    w = np.asarray(weights, float)
    c = [float((w**k).sum()) for k in range(1, 5)]
    s1, s2 = c[2] / c[1] ** 1.5, c[3] / c[1] ** 2
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        delta = s1 * a**3 - a * a
        df = a * a - 2 * delta
    else:
        a, delta, df = 1 / s1, 0.0, 1 / s1**2
    x = (q - c[0]) / math.sqrt(2 * c[1]) * math.sqrt(2) * a + df + delta
    if x <= 0:
        return 1.0
    if delta == 0:
        return float(chi2_sf(x, df))
    total, j, seen = 0.0, 0, 0.0
    while seen < 1 - 1e-12 and j < 2000:
        weight = float(poisson_sf(j, delta / 2) - poisson_sf(j + 1, delta / 2))
        total += weight * float(chi2_sf(x, df + 2 * j))
        seen += weight
        j += 1
    return total


def imhof_tail(q: float, weights, tolerance: float = 1e-10) -> float:
    """P(sum of w_i chi2_1 > q), weights of either sign, by inverting the characteristic function: 1/2 + 1/pi times the integral of
    sin(theta(u)) / (u rho(u)) over u > 0, with theta = (sum atan(w_i u) - q u) / 2 and rho = prod (1 + w_i^2 u^2)^(1/4).

    The integral is summed over windows of a few periods by Gauss-Legendre rules until what the tail can add is below the tolerance;
    its remaining alternating windows are accelerated by repeated means. Small tails are better taken from ``saddlepoint_tail``.
    """
    w = np.asarray(weights, float)
    w = w[np.abs(w) > 1e-12 * max(np.abs(w).max(initial=0.0), 1e-300)]
    if not len(w):
        return float(q < 0)
    scale = np.abs(w).max()
    w, q = w / scale, q / scale
    x, g = np.polynomial.legendre.leggauss(24)
    logs = np.log(np.abs(w)).sum() / 2

    def value(u: np.ndarray) -> np.ndarray:
        theta = 0.5 * (np.arctan(np.multiply.outer(u, w)).sum(axis=1) - q * u)
        return np.sin(theta) / (u * np.exp(0.25 * np.log1p(np.multiply.outer(u, w) ** 2).sum(axis=1)))

    speed = 0.5 * (np.abs(w).sum() + abs(q))
    step, at, total, sums = math.pi / max(speed, 1e-12), 0.0, 0.0, []
    for n in range(200_000):
        width = step if n < 64 else max(step, min(at * 0.05, math.pi / max(abs(q) / 2, 1e-12)))
        u = at + width / 2 * (x + 1)
        total += width / 2 * float((g * value(u)).sum())
        at += width
        sums.append(total)
        left = math.exp(min(700.0, math.log(2 / len(w)) - len(w) / 2 * math.log(at) - logs))
        if left < tolerance:
            break
        if q and n > 4000:
            break
    tail = sums[-24:] if left >= tolerance and q else sums[-1:]
    while len(tail) > 1:  # means of neighbours: errors that change sign cancel
        tail = [(a + b) / 2 for a, b in zip(tail, tail[1:])]
    return min(1.0, max(0.0, 0.5 + tail[0] / math.pi))


def saddlepoint_tail(q: float, weights) -> float:
    """P(sum of w_i chi2_1 > q) by the saddle point of the cumulant generating function -1/2 sum log(1 - 2 w_i t): exact in relative terms far out."""
    from helixframe.functions.dist import norm_sf

    w = np.asarray(weights, float)
    w = w[np.abs(w) > 1e-12 * max(np.abs(w).max(initial=0.0), 1e-300)]
    if not len(w):
        return float(q < 0)
    scale = np.abs(w).max()
    w, q = w / scale, q / scale
    if w.max() < 0 <= q or w.min() > 0 >= q:
        return float(w.min() > 0)
    if abs(q - w.sum()) < 1e-7 * np.sqrt(2 * (w * w).sum()):
        return imhof_tail(q, w)
    lo = 1 / (2 * w.min()) * (1 - 1e-12) if w.min() < 0 else -len(w) / 2 / max(q, 1e-12) - 1
    hi = 1 / (2 * w.max()) * (1 - 1e-12) if w.max() > 0 else len(w) / 2 / max(-q, 1e-12) + 1
    slope = lambda t: float((w / (1 - 2 * w * t)).sum()) - q
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if slope(mid) > 0 else (mid, hi)
    t = (lo + hi) / 2
    k = -0.5 * float(np.log1p(-2 * w * t).sum())
    r = math.copysign(math.sqrt(max(0.0, 2 * (t * q - k))), t)
    u = t * math.sqrt(2 * float((w * w / (1 - 2 * w * t) ** 2).sum()))
    if abs(r) < 1e-6 or u == 0:
        return imhof_tail(q, w)
    return min(1.0, max(0.0, float(norm_sf(r + math.log(u / r) / r))))


def weighted_chi_square_tail(q: float, weights) -> float:
    """The integral's value, or the saddle point's where the tail is too small for the integral's absolute error."""
    p = imhof_tail(q, weights)
    return p if p > 1e-9 else saddlepoint_tail(q, weights)
