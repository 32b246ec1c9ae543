"""Models: closed forms from sufficient statistics as aggregates, iterative ones per group as vectorised functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from helixframe.functions import dist
from helixframe.session import stored


def ols_simple(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope, intercept, their standard errors, R2 and n of y ~ x per group, in one aggregation (df = n - 2)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    rss = F.col("syy") - slope * F.col("sxy")
    sigma2 = F.when(F.col("n") > 2, rss / (F.col("n") - 2))
    return s.select(*by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.sqrt(sigma2 / F.col("sxx")).alias("slope_se"), F.sqrt(sigma2 * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx"))).alias("intercept_se"), F.when(F.col("syy") > 0, 1 - rss / F.col("syy")).alias("r2"))


def through_origin_3sigma(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope through the origin after leaving out rows more than three residual deviations off a first fit: two passes of aggregates."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    first = d.agg((F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") * F.col("_x"))).alias("_b"))
    rest = d.crossJoin(F.broadcast(first)).withColumn("_e", F.col("_y") - F.col("_b") * F.col("_x"))
    sd = rest.agg(F.stddev_samp("_e").alias("_s"))
    kept = rest.crossJoin(F.broadcast(sd)).where(F.abs("_e") <= 3 * F.col("_s"))
    return kept.agg((F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") * F.col("_x"))).alias("slope"), F.count("*").alias("n"))


def normal_equations(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """X'X (upper, by rows), X'y, y'y and n with a leading intercept, per group: sums that combine map-side for any number of rows."""
    d = df.dropna(subset=[y, *xs])
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    upper = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return d.groupBy(*by).agg(F.array(*upper).alias("xtx"), F.array(*[F.sum(c * F.col(y)) for c in cols]).alias("xty"), F.sum(F.col(y) * F.col(y)).alias("yty"), F.sum(y).alias("sy"), F.count("*").alias("n"))


def _solve(xtx: np.ndarray, xty: np.ndarray, yty: float, sy: float, n: int, ridge: float, drop_collinear: bool) -> dict:
    k = len(xty)
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = xtx
    a = a + np.triu(a, 1).T + ridge * np.diag([0.0] + [1.0] * (k - 1))
    use = list(range(k))
    if drop_collinear:  # columns whose pivot vanishes given those before are left out
        use, kept = [], []
        for c in range(k):
            t = [*kept, c]
            sub = a[np.ix_(t, t)]
            scale = np.sqrt(np.diag(sub))
            if np.linalg.matrix_rank(sub / np.outer(scale, scale), tol=1e-9) == len(t):
                kept.append(c)
        use = kept
    beta, se = np.full(k, np.nan), np.full(k, np.nan)
    scale = np.sqrt(np.diag(a)[use])
    if not (scale > 0).all() or np.linalg.matrix_rank(a[np.ix_(use, use)] / np.outer(scale, scale), tol=1e-9) < len(use):
        return {"beta": beta, "se": se, "r2": np.nan, "loglik": np.nan}
    try:
        inv = np.linalg.inv(a[np.ix_(use, use)])
    except np.linalg.LinAlgError:
        return {"beta": beta, "se": se, "r2": np.nan, "loglik": np.nan}
    b = inv @ xty[use]
    rss = max(0.0, yty - 2 * b @ xty[use] + b @ (a[np.ix_(use, use)] - ridge * np.diag([0.0 if u == 0 else 1.0 for u in use])) @ b)
    beta[use] = b
    if n > 2:
        se[use] = np.sqrt(np.maximum(0, np.diag(inv) * rss / (n - 2)))
    tss = yty - sy * sy / n
    return {"beta": beta, "se": se, "r2": 1 - rss / tss if tss > 0 else np.nan, "loglik": -n / 2 * (np.log(2 * np.pi * rss / n) + 1) if rss > 0 else np.nan}


def ols(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], ridge: float = 0.0, drop_collinear: bool = False) -> DataFrame:
    """Linear (or ridge) regression per group: a row a term with beta, se, t, two-sided p (df = n - 2), r2, log-likelihood and n. Rows with a null are left out; a singular group gives nulls."""
    sums = normal_equations(df, by, y, xs)
    names = ["intercept", *xs]

    def fit(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                got = _solve(np.asarray(r["xtx"], float), np.asarray(r["xty"], float), r["yty"], r["sy"], r["n"], ridge, drop_collinear)
                for term, b, s in zip(names, got["beta"], got["se"]):
                    sound = np.isfinite(s) and 0 < s <= 1e7
                    t = b / s if sound else np.nan
                    p = float(2 * dist.t_sf(abs(t), r["n"] - 2)) if sound else np.nan
                    out.append([*[r[c] for c in by], term, b, s, t, p, got["r2"], got["loglik"], r["n"]])
            got = pd.DataFrame(out, columns=[*by, "term", "beta", "se", "t", "p", "r2", "loglik", "n"])
            yield got.astype({"n": "int64"})

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.schema if f.name in by)
    found = sums.mapInPandas(fit, keys + "term string, beta double, se double, t double, p double, r2 double, loglik double, n long")
    return found.select(*by, "term", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("beta", "se", "t", "p", "r2", "loglik")], "n")


def irls(x: np.ndarray, y: np.ndarray, weights: np.ndarray, family: str, steps: int = 40, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, standard errors and log-likelihood of a logistic or Poisson model by iteratively reweighted least squares; NaN when it fails."""
    import math

    beta = np.zeros(x.shape[1])
    last = -np.inf
    for _ in range(steps):
        eta = np.clip(x @ beta, -30, 30)
        if family == "logistic":
            mu = 1 / (1 + np.exp(-eta))
            var = mu * (1 - mu)
            ll = float((weights * (y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300)))).sum())
        else:
            mu = var = np.exp(eta)
            ll = float((weights * (y * eta - mu - np.array([math.lgamma(v + 1) for v in y]))).sum())
        info = (x * (weights * var)[:, None]).T @ x
        try:
            inv = np.linalg.inv(info)
        except np.linalg.LinAlgError:
            return np.full_like(beta, np.nan), np.full_like(beta, np.nan), np.nan
        if abs(ll - last) < tolerance * (abs(ll) + 1e-8) * 1e-3:
            return beta, np.sqrt(np.diag(inv)), ll
        last = ll
        beta = beta + inv @ (x.T @ (weights * (y - mu)))
    return np.full_like(beta, np.nan), np.full_like(beta, np.nan), np.nan


def _glm_step(counted: DataFrame, keys: Sequence[str], beta: DataFrame, family: str, k: int) -> DataFrame:
    """(keys, beta, info, score, ll, n): the sums of a Newton step at ``beta`` (keys, beta), a row a group."""
    match = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    at = beta.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("beta").alias("_beta"))
    rows = counted.join(at, match)
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(k - 1)]]
    eta = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), sum((F.col("_beta")[i] * c for i, c in enumerate(x)), F.lit(0.0))))
    rows = rows.withColumn("_eta", eta)
    y, w = F.col("_y"), F.col("_w").cast("double")
    if family == "logistic":
        rows = rows.withColumn("_mu", 1 / (1 + F.exp(-F.col("_eta")))).withColumn("_var", F.col("_mu") * (1 - F.col("_mu")))
        ll = y * F.log(F.col("_mu")) + (1 - y) * F.log(1 - F.col("_mu"))
    else:
        rows = rows.withColumn("_mu", F.exp("_eta")).withColumn("_var", F.col("_mu"))
        ll = y * F.col("_eta") - F.col("_mu") - F.col("_lf")
    info = F.array(*[F.sum(w * F.col("_var") * x[i] * x[j]) for i in range(k) for j in range(i, k)])
    score = F.array(*[F.sum(w * (y - F.col("_mu")) * c) for c in x])
    return rows.groupBy(*keys).agg(F.first("_beta").alias("beta"), info.alias("info"), score.alias("score"), F.sum(w * ll).alias("ll"), F.sum("_w").alias("n"))


@pandas_udf(T.DoubleType())
def _log_factorial(y: pd.Series) -> pd.Series:
    import math

    return pd.Series([math.lgamma(v + 1) if v > -1 else np.nan for v in y])


def glm(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], family: str = "logistic", steps: int = 40, tolerance: float = 1e-8) -> DataFrame:
    """Logistic (y in 0/1) or Poisson regression per group: term, beta, se, z, p, loglik, n.

    Iteratively reweighted least squares by sums: a step is one aggregation of weighted products that combines map-side, whatever the number of rows of
    a group, and a solution of (terms x terms) systems, a row a group. Identical (y, x) rows are counted first. Groups that have converged drop out;
    those that do not within ``steps``, or are singular, have nulls. Rows with a null are left out.
    """
    counted = df.dropna(subset=[y, *xs]).groupBy(*by, F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(xs)]).agg(F.count("*").alias("_w"))
    names, k = ["intercept", *xs], 1 + len(xs)
    keys = list(by) or ["_all"]
    if not by:
        counted = counted.withColumn("_all", F.lit(1))
    if family != "logistic":
        counted = counted.withColumn("_lf", _log_factorial("_y"))
    counted = stored(counted, "counted")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counted.schema if f.name in keys)
    now = counted.select(*keys).distinct().select(*keys, F.array_repeat(F.lit(0.0), k).alias("beta"), F.lit(None).cast("double").alias("last"))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.zeros((k, k))
                a[np.triu_indices(k)] = r["info"]
                a += np.triu(a, 1).T
                beta, se, state = np.asarray(r["beta"], float), [], "on"
                try:
                    inverse = np.linalg.inv(a)
                    if not np.isfinite(inverse).all():
                        raise np.linalg.LinAlgError
                except np.linalg.LinAlgError:
                    state = "failed"
                else:
                    if r["last"] is not None and abs(r["ll"] - r["last"]) < tolerance * (abs(r["ll"]) + 1e-8):
                        state, se = "done", [float(v) for v in np.sqrt(np.maximum(np.diag(inverse), 0))]
                    else:
                        beta = beta + inverse @ np.asarray(r["score"], float)
                out.append([*[r[c] for c in keys], [float(v) for v in beta], se, float(r["ll"]), int(r["n"]), state])
            yield pd.DataFrame(out, columns=[*keys, "beta", "se", "last", "n", "state"])

    ended = []
    for step in range(steps):
        sums = _glm_step(counted, keys, now, family, k)
        match = [F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(keys)]
        before = now.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(keys)], "last")
        met = sums.join(before, match).select(*keys, "beta", "info", "score", "ll", "n", "last")
        got = stored(met.mapInPandas(solve, kinds + "beta array<double>, se array<double>, last double, n long, state string"), "step")
        ended.append(got.where("state <> 'on'"))
        now = got.where("state = 'on'").select(*keys, "beta", "last")
        if now.isEmpty():
            break
    else:
        ended.append(got.where("state = 'on'").withColumn("state", F.lit("failed")))
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    fine = F.col("state") == "done"
    terms = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.when(fine, F.col("beta")[i]).alias("beta"), F.when(fine, F.get("se", F.lit(i))).alias("se")) for i, t in enumerate(names)])).alias("t")
    rows = every.select(*keys, terms, F.when(fine, F.col("last")).alias("loglik"), "n").select(*keys, "t.*", "loglik", "n")
    rows = rows.withColumn("z", F.try_divide("beta", "se"))
    return rows.select(*by, "term", "beta", "se", "z", (2 * dist.normal_upper(F.abs("z"))).alias("p"), "loglik", "n")


def score_test(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Score statistic of x in a logistic model with intercept, per group: U2 / V, a chi-square with 1 df, as plain aggregates."""
    d = df.dropna(subset=[y, x])
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("_p"), F.sum(F.col(x) * F.col(y)).alias("_xy"), F.sum(x).alias("_sx"), F.sum(F.col(x) * F.col(x)).alias("_sxx"))
    u = F.col("_xy") - F.col("_p") * F.col("_sx")
    v = F.col("_p") * (1 - F.col("_p")) * (F.col("_sxx") - F.col("_sx") * F.col("_sx") / F.col("n"))
    return s.select(*by, "n", F.when(v > 0, u * u / v).alias("score_chisq"))


def likelihood_ratio(loglik_small, loglik_large, df: float) -> tuple[float, float]:
    """(statistic, p); df within 1e-4 below 1 counts as 1, smaller raises."""
    if 1 - 1e-4 <= df < 1:
        df = 1
    if df < 1:
        raise ValueError("degrees of freedom below 1")
    stat = max(0.0, 2 * (loglik_large - loglik_small))
    return stat, float(dist.chi2_sf(stat, df))


def nested_models(small: DataFrame, large: DataFrame, by: Sequence[str], terms_small: int, terms_large: int) -> DataFrame:
    """(by.., statistic, p, bic_small, bic_large) of two fits of the same rows, tables with ``loglik`` and ``n`` a group (as ``ols`` and ``glm`` give them): the likelihood-ratio test and both BIC."""
    one = lambda df, tag: df.groupBy(*by).agg(F.max("loglik").alias(f"_l{tag}"), F.max("n").alias(f"_n{tag}"))
    a, b = one(small, "0"), one(large, "1").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_l1", "_n1")
    met = a.join(b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    stat = F.greatest(F.lit(0.0), 2 * (F.col("_l1") - F.col("_l0")))
    bic = lambda tag, k: k * F.log(F.col(f"_n{tag}")) - 2 * F.col(f"_l{tag}")
    return met.select(*by, stat.alias("statistic"), dist.chisq_upper(stat, F.lit(float(terms_large - terms_small))).alias("p"), bic("0", terms_small).alias("bic_small"), bic("1", terms_large).alias("bic_large"))


def proximal_gradient(x: np.ndarray, y: np.ndarray, penalty: str, lam: float, alpha: float = 0.5, a: float = 3.7, steps: int = 5000, tolerance: float = 1e-10) -> np.ndarray:
    """Penalised least squares, mean squared error / 2 + penalty: l1, l2, elastic (alpha on l1) or scad; no intercept."""
    n = len(y)
    step = n / max(np.linalg.norm(x, 2) ** 2, 1e-12)
    beta = np.zeros(x.shape[1])
    soft = lambda v, t: np.sign(v) * np.maximum(np.abs(v) - t, 0)
    for _ in range(steps):
        v = beta - step * (x.T @ (x @ beta - y)) / n
        if penalty == "l1":
            new = soft(v, step * lam)
        elif penalty == "l2":
            new = v / (1 + step * lam)
        elif penalty == "elastic":
            new = soft(v, step * lam * alpha) / (1 + step * lam * (1 - alpha))
        else:
            size = np.abs(v)
            new = np.where(size <= lam * (1 + step), soft(v, step * lam), np.where(size <= a * lam, ((a - 1) * v - np.sign(v) * a * lam * step) / (a - 1 - step) if a - 1 > step else v, v))
        done = np.abs(new - beta).max(initial=0) < tolerance
        beta = new
        if done:
            break
    return beta


def poisson_mixture(counts: np.ndarray, weights: np.ndarray, k: int, starts: int = 5, steps: int = 500, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Means, shares and log-likelihood of a Poisson mixture by EM over distinct counts with weights; the best of several seeded starts, means ascending."""
    import math

    r = np.random.default_rng(seed)
    lf = np.array([math.lgamma(c + 1) for c in counts])
    best = None
    for _ in range(starts):
        mean = np.sort(r.uniform(max(counts.min(), 0.1), counts.max() + 0.1, k))
        share = np.full(k, 1 / k)
        last = -np.inf
        for _ in range(steps):
            logs = np.log(share)[None, :] + counts[:, None] * np.log(mean)[None, :] - mean[None, :] - lf[:, None]
            top = logs.max(axis=1, keepdims=True)
            post = np.exp(logs - top)
            total = post.sum(axis=1, keepdims=True)
            ll = float((weights * (top[:, 0] + np.log(total[:, 0]))).sum())
            post = post / total * weights[:, None]
            share = np.maximum(post.sum(axis=0) / weights.sum(), 1e-12)
            mean = np.maximum((post * counts[:, None]).sum(axis=0) / np.maximum(post.sum(axis=0), 1e-12), 1e-6)
            if ll - last < 1e-10 * (1 + abs(ll)):
                break
            last = ll
        if best is None or ll > best[2]:
            order = np.argsort(mean)
            best = mean[order], share[order], ll
    return best


def fit_poisson_mixture(df: DataFrame, count: str, k: int) -> DataFrame:
    """(component, mean, share, loglik) of a column of counts; only distinct counts leave the executors' aggregation."""
    c = df.where(F.col(count).isNotNull()).groupBy(F.col(count).cast("double").alias("c")).agg(F.count("*").alias("w")).withColumn("g", F.lit(1))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        mean, share, ll = poisson_mixture(pdf["c"].to_numpy(), pdf["w"].to_numpy(float), k)
        return pd.DataFrame({"component": range(k), "mean": mean, "share": share, "loglik": ll})

    return c.groupBy("g").applyInPandas(fit, "component int, mean double, share double, loglik double")


def reml(y: np.ndarray, x: np.ndarray, kernel: np.ndarray) -> tuple[float, float, float]:
    """(genetic, residual variance, restricted log-likelihood) of y = Xb + g + e, g ~ N(0, vg K), by one eigendecomposition and a search over the ratio."""
    values, vectors = np.linalg.eigh(kernel)
    yt, xt = vectors.T @ y, vectors.T @ x
    n, p = x.shape

    def fit(ratio: float) -> tuple[float, float]:
        d = ratio * values + (1 - ratio)
        d = np.maximum(d, 1e-10)
        xdx = (xt / d[:, None]).T @ xt
        b = np.linalg.solve(xdx, (xt / d[:, None]).T @ yt)
        rest = yt - xt @ b
        s = float((rest * rest / d).sum() / (n - p))
        return -0.5 * ((n - p) * np.log(2 * np.pi * s) + np.log(d).sum() + np.linalg.slogdet(xdx)[1] + (n - p)), s

    grid = np.linspace(0, 0.999, 60)
    at = max(grid, key=lambda r: fit(r)[0])
    lo, hi = max(0.0, at - 0.02), min(0.9999, at + 0.02)
    for _ in range(80):
        a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if fit(a)[0] > fit(b)[0] else (a, hi)
    ratio = (lo + hi) / 2
    ll, s = fit(ratio)
    return ratio * s, (1 - ratio) * s, ll


def kmeans(x: np.ndarray, k: int, steps: int = 100, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centres and within sum of squares (squared Euclidean, k-means++ start)."""
    r = np.random.default_rng(seed)
    centres = x[[r.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.concatenate([centres, x[[r.choice(len(x), p=d / d.sum())]] if d.sum() > 0 else x[[r.integers(len(x))]]])
    label = np.zeros(len(x), int)
    for _ in range(steps):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        new = d.argmin(axis=1)
        centres = np.array([x[new == c].mean(axis=0) if (new == c).any() else centres[c] for c in range(k)])
        if (new == label).all() and _:
            break
        label = new
    return label, centres, float(((x - centres[label]) ** 2).sum())


def pca(df: DataFrame, row: str, values: Sequence[str], k: int) -> DataFrame:
    """Scores on the first k principal components of numeric columns: the covariance is one aggregation (columns squared in size), the scores one projection."""
    cols = [F.col(c).cast("double") for c in values]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = df.dropna(subset=list(values)).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if got["m0"] is None:
        return df.limit(0).select(row, *[F.lit(0.0).alias(f"pc{i + 1}") for i in range(k)])
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] or 0.0
    value, vector = np.linalg.eigh(cov)
    vector = vector[:, np.argsort(-value)[:k]]
    vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), range(vector.shape[1])] < 0, -1, 1)
    scores = [sum(((c - F.lit(float(got[f"m{i}"]))) * F.lit(float(vector[i, n])) for i, c in enumerate(cols)), F.lit(0.0)).alias(f"pc{n + 1}") for n in range(vector.shape[1])]
    return df.dropna(subset=list(values)).select(row, *scores)


def explained(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """(component, eigenvalue, expected, useful) of the correlation matrix of numeric columns, from one aggregation: by the broken stick, a component is useful whose eigenvalue exceeds 1/k + 1/(k+1) + .. + 1/p.

    Rows with a null are left out; a column that does not vary correlates with none.
    """
    cols, p = [F.col(c).cast("double") for c in values], len(values)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = df.dropna(subset=list(values)).agg(*[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] or 0.0
    sd = np.sqrt(np.diag(cov))
    corr = np.divide(cov, np.outer(sd, sd), out=np.eye(p), where=np.outer(sd, sd) > 0)
    eigen = np.linalg.eigvalsh(corr)[::-1]
    expected = [sum(1 / i for i in range(k, p + 1)) for k in range(1, p + 1)]
    return df.sparkSession.createDataFrame([(k, float(e), x, bool(e > x)) for k, (e, x) in enumerate(zip(eigen, expected))], "component int, eigenvalue double, expected double, useful boolean")


def gram_components(gram: DataFrame, k: int, rounds: int = 6, spare: int = 6, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """Leading eigenvectors of a symmetric matrix of rows (i, j, value), given as its lower triangle: (i, component, score), scores scaled by the root of
    the eigenvalue; and the k greatest eigenvalues.

    Block Krylov: ``rounds`` times the matrix, a table, is multiplied with the last k + spare columns by a join and sums; the eigenvectors are the best ones
    within the span of all columns so far. Rows of the columns stay on the cluster; only products of columns with each other come to the driver,
    ((k + spare) (rounds + 1)) squared numbers. A component's largest score is positive.
    """
    m = k + spare
    both = stored(gram.select("i", "j", "value").unionByName(gram.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value")), "gram")

    def product(columns: DataFrame, name: str, n: int) -> DataFrame:
        """(j, out): the matrix times an array column of n columns."""
        got = both.join(columns.select("j", F.col(name).alias("_v")), "j").groupBy("i").agg(*[F.sum(F.col("value") * F.col("_v")[c]).alias(f"c{c}") for c in range(n)])
        return got.select(F.col("i").alias("j"), F.array(*[f"c{c}" for c in range(n)]).alias("out"))

    def crossed(rows: DataFrame, left: str, right: str, n: int) -> np.ndarray:
        at = [(a, b) for a in range(n) for b in range(a, n)]
        sums = F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in at]), lambda p: F.element_at(left, p["a"] + 1) * F.element_at(right, p["b"] + 1))
        got = rows.select(F.posexplode(sums).alias("n", "v")).groupBy("n").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((n, n))
        for r in got:
            a, b = at[r["n"]]
            out[a, b] = out[b, a] = r["v"] or 0.0
        return out

    def mixed(column: str, weights: np.ndarray) -> Column:
        turned = [F.aggregate(F.zip_with(column, F.array(*[F.lit(float(x)) for x in weights[:, c]]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for c in range(weights.shape[1])]
        return F.array(*turned)

    def whitener(square: np.ndarray) -> np.ndarray:
        scale, turn = np.linalg.eigh(square)
        good = scale > max(scale.max(initial=0), 1e-300) * 1e-12
        return turn[:, good] / np.sqrt(scale[good])

    start = F.array(*[F.randn(seed + c) for c in range(m)])
    basis = stored(both.select(F.col("i").alias("j")).distinct().orderBy("j").select("j", start.alias("last")).withColumn("all", F.col("last")), "columns")
    n = width = m
    for _ in range(rounds):
        step = stored(basis.join(product(basis, "last", width), "j"), "columns")
        turn = whitener(crossed(step, "out", "out", width))
        if not turn.shape[1]:
            break
        basis = step.select("j", mixed("out", turn).alias("last"), "all").withColumn("all", F.concat("all", "last"))
        width, n = turn.shape[1], n + turn.shape[1]
    last = stored(basis.join(product(basis, "all", n), "j"), "columns")
    span = whitener(crossed(last, "all", "all", n))
    value, turn = np.linalg.eigh(span.T @ crossed(last, "all", "out", n) @ span)
    at = np.argsort(-value)[:k]
    found = len(at)
    scores = stored(last.select("j", mixed("all", span @ turn[:, at] * np.sqrt(np.maximum(value[at], 0))).alias("v")), "scores")
    sign = scores.agg(*[F.max_by(F.col("v")[c], F.struct(F.abs(F.col("v")[c]), F.col("j"))).alias(f"s{c}") for c in range(found)]).first() if found else []
    flipped = F.array(*[F.col("v")[c] * F.lit(-1.0 if (sign[c] or 0) < 0 else 1.0) for c in range(found)])
    return scores.select(F.col("j").alias("i"), F.posexplode(flipped).alias("component", "score")), [float(x) for x in value[at]]


def global_test_statistic(df: DataFrame, by: Sequence[str], y: str, marker: str, x: str, weight: str | None = None) -> DataFrame:
    """Sum over markers of weight * (sum of x times centred y) squared, over the residual variance, per group: two aggregations."""
    d = df.dropna(subset=[y, x])
    s = d.groupBy(*by, marker).agg((F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.avg(y)).alias("_u"), (F.var_pop(y)).alias("_v"), (F.max(weight) if weight else F.lit(1.0)).alias("_w"))
    return s.groupBy(*by).agg((F.sum(F.col("_w") * F.col("_u") * F.col("_u")) / F.avg("_v")).alias("q"), F.count("*").alias("n_markers"))


def permutation_p(seen: float, drawn: np.ndarray) -> float:
    """Share of drawn statistics at or beyond the seen one, counting the seen one itself."""
    return float((1 + (np.asarray(drawn) >= seen).sum()) / (1 + len(drawn)))
