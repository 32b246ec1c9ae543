"""Penalised least squares along a path of penalties with cross-validation, from one sum of products a fold.

The rows are read once: each fold's products of the columns with each other and with the response are one aggregation that combines map-side.
A training set's products are the total less a fold's, the error on a fold follows from its own products, so
neither fits nor errors touch a row again; what is iterated is as large as the columns squared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from helixframe.operators import models, sets

PENALTIES = ("l1", "l2", "elastic", "scad")


@dataclass
class Products:
    """X'X with a leading intercept, X'y, y'y and the number of rows."""

    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    n: int

    def __sub__(self, other: Products) -> Products:
        return Products(self.xtx - other.xtx, self.xty - other.xty, self.yty - other.yty, self.n - other.n)

    def __add__(self, other: Products) -> Products:
        return Products(self.xtx + other.xtx, self.xty + other.xty, self.yty + other.yty, self.n + other.n)

    def error(self, beta: np.ndarray) -> float:
        """Sum of squared residuals."""
        return max(0.0, float(self.yty - 2 * beta @ self.xty + beta @ self.xtx @ beta))


def fold_products(df: DataFrame, y: str, xs: Sequence[str], fold: str) -> dict[int, Products]:
    """Products by fold number; rows with a null are left out."""
    k, out = 1 + len(xs), {}
    for r in models.normal_equations(df, [fold], y, xs).collect():  # a row a fold
        a = np.zeros((k, k))
        a[np.triu_indices(k)] = r["xtx"]
        out[r[fold]] = Products(a + np.triu(a, 1).T, np.array(r["xty"]), float(r["yty"]), r["n"])
    return out


def _threshold(penalty: str, lam: float, alpha: float, a: float) -> Callable[[float, float], float]:
    """The minimiser of 1/2 v b^2 - z b + penalty(b) for a coordinate: of (z, v)."""
    soft = lambda z, t: np.sign(z) * max(0.0, abs(z) - t)
    if penalty == "l1":
        return lambda z, v: soft(z, lam) / v
    if penalty == "l2":
        return lambda z, v: z / (v + lam)
    if penalty == "elastic":
        return lambda z, v: soft(z, lam * alpha) / (v + lam * (1 - alpha))

    def scad(z: float, v: float) -> float:
        b = z / v
        if abs(b) <= lam + lam / v:
            return soft(z, lam) / v
        if abs(b) <= a * lam and v * (a - 1) > 1:
            return soft(z, a * lam / (a - 1)) / (v - 1 / (a - 1))
        return b

    return scad


def coordinate_descent(c: np.ndarray, z: np.ndarray, penalty: str, lam: float, free: np.ndarray, beta: np.ndarray, alpha: float = 0.5, a: float = 3.7, steps: int = 10_000, tolerance: float = 1e-11) -> np.ndarray:
    """Minimiser of 1/2 b'Cb - b'z + penalty, coordinate by coordinate from ``beta``; those that are ``free`` bear no penalty."""
    beta, shrink = beta.copy(), _threshold(penalty, lam, alpha, a)
    for _ in range(steps):
        most = 0.0
        for j in range(len(beta)):
            if c[j, j] <= 1e-12:
                continue
            rest = z[j] - c[j] @ beta + c[j, j] * beta[j]
            new = rest / c[j, j] if free[j] else shrink(rest, c[j, j])
            most = max(most, abs(new - beta[j]))
            beta[j] = new
        if most < tolerance:
            break
    return beta


def fit_path(p: Products, penalty: str, lams: Sequence[float], free: np.ndarray, alpha: float = 0.5) -> list[np.ndarray]:
    """Coefficients (intercept first) for each penalty, from columns at mean 0 and variance 1 (of n), scaled back; each fit starts from the one before."""
    n = p.n
    mean = p.xtx[0, 1:] / n
    c = p.xtx[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    on = sd > 1e-9 * np.maximum(1e-300, np.sqrt(np.diag(p.xtx)[1:] / n))
    scale = np.where(on, sd, 1.0)
    c = np.where(np.outer(on, on), c / np.outer(scale, scale), 0.0)
    z = np.where(on, (p.xty[1:] / n - mean * p.xty[0] / n) / scale, 0.0)
    beta, out = np.zeros(len(z)), []
    for lam in lams:
        beta = coordinate_descent(c, z, penalty, lam, free, beta, alpha)
        b = np.where(on, beta / scale, 0.0)
        out.append(np.concatenate([[p.xty[0] / n - b @ mean], b]))
    return out


def default_path(p: Products, count: int = 20, ratio: float = 1e-3) -> list[float]:
    """Falling penalties from the least that leaves no column in (under l1) to its ``ratio``."""
    mean = p.xtx[0, 1:] / p.n
    sd = np.sqrt(np.maximum(np.diag(p.xtx)[1:] / p.n - mean * mean, 0))
    z = np.abs(p.xty[1:] / p.n - mean * p.xty[0] / p.n) / np.where(sd > 0, sd, np.inf)
    return list(np.geomspace(max(z.max(initial=0.0), 1e-12), max(z.max(initial=0.0), 1e-12) * ratio, count))


def cross_validated_path(df: DataFrame, key: str, y: str, xs: Sequence[str], penalty: str = "l1", lams: Sequence[float] | None = None, k: int = 5, alpha: float = 0.5, unpenalised: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """A row a penalty and term: (lambda, term, beta, cv_error, chosen), by falling penalty.

    Columns count at variance 1 and the loss is the mean squared error / 2; folds go by hash numbers of ``key``. cv_error is the mean squared error over all held-out rows, ``chosen``
    the penalty of the least (ties to the greater penalty). Rows with a null are left out; fewer than two folds with rows raise an error.
    """
    if penalty not in PENALTIES:
        raise ValueError(f"penalty {penalty}: one of {', '.join(PENALTIES)}")
    by = fold_products(sets.folds(df.where(F.col(key).isNotNull()), key, k, seed, "_fold"), y, xs, "_fold")
    if len(by) < 2:
        raise ValueError("cross-validation needs rows in two folds at least")
    total = sum(list(by.values())[1:], next(iter(by.values())))
    lams = sorted(lams, reverse=True) if lams is not None else default_path(total)
    free = np.array([x in set(unpenalised) for x in xs])
    error = np.zeros(len(lams))
    for held in by.values():
        error += [held.error(b) for b in fit_path(total - held, penalty, lams, free, alpha)]
    error /= total.n
    best = int(np.flatnonzero(error <= error.min() * (1 + 1e-12))[0])
    rows = [(float(lam), t, float(b), float(error[i]), i == best) for i, (lam, beta) in enumerate(zip(lams, fit_path(total, penalty, lams, free, alpha))) for t, b in zip(["intercept", *xs], beta)]
    return df.sparkSession.createDataFrame(rows, "`lambda` double, term string, beta double, cv_error double, chosen boolean")


def nested_cross_validation(df: DataFrame, key: str, y: str, xs: Sequence[str], penalty: str = "l1", lams: Sequence[float] | None = None, k: int = 5, alpha: float = 0.5, unpenalised: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """The error of the whole procedure: (fold, chosen_lambda, n, mse, r2). For each outer fold the penalty is chosen by the error on the other folds in turn, then
    the fit on all of them is judged on the outer one. The same products by fold serve both levels."""
    by = fold_products(sets.folds(df.where(F.col(key).isNotNull()), key, k, seed, "_fold"), y, xs, "_fold")
    if len(by) < 3:
        raise ValueError("nested cross-validation needs rows in three folds at least")
    total = sum(list(by.values())[1:], next(iter(by.values())))
    lams = sorted(lams, reverse=True) if lams is not None else default_path(total)
    free = np.array([x in set(unpenalised) for x in xs])
    rows = []
    for name, outer in sorted(by.items()):
        rest = total - outer
        error = sum(np.array([inner.error(b) for b in fit_path(rest - inner, penalty, lams, free, alpha)]) for other, inner in by.items() if other != name)
        best = int(np.flatnonzero(error <= error.min() * (1 + 1e-12))[0])
        left = outer.error(fit_path(rest, penalty, lams[: best + 1], free, alpha)[-1])
        spread = outer.yty - outer.xty[0] ** 2 / outer.n
        rows.append((int(name), float(lams[best]), outer.n, left / outer.n, float(1 - left / spread) if spread > 0 else None))
    return df.sparkSession.createDataFrame(rows, "fold int, chosen_lambda double, n long, mse double, r2 double")
