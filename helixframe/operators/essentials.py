"""Gene essentiality from counts of truncating variants: a mixture of two Poisson rates over each gene's expected count.

A gene expects e truncations were it free to lose a copy. Haplosufficient genes show e (1 + f), with f the rate of false calls; a share phi of
genes, haploinsufficient ones, only the part (1 - penetrance) of it. All fits work on counts of genes by (observed, expected), which combine map-side:
an expectation step is one aggregation over that histogram for all replicates at once, with a row of parameters a replicate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from helixframe.functions import dist
from helixframe.operators import sets
from helixframe.session import stored


def expected_counts(genes: DataFrame, synonymous: str, p_truncation: str, p_synonymous: str) -> DataFrame:
    """Add ``expected``: the truncations that the gene's synonymous variants foretell, slope * p_truncation / p_synonymous of what a line through the origin of synonymous counts on their
    probability explains, the three-deviation outliers aside. Genes with a null or without synonymous probability have none."""
    from helixframe.operators.models import through_origin_3sigma

    slope = through_origin_3sigma(genes.where(F.col(p_synonymous) > 0), synonymous, p_synonymous).select(F.col("slope").alias("_slope"))  # one row
    return genes.crossJoin(F.broadcast(slope)).withColumn("expected", F.when(F.col(p_synonymous) > 0, F.col("_slope") * F.col(p_truncation))).drop("_slope")


def histogram(genes: DataFrame, observed: str, expected: str, replicates: int = 0, key: str = "gene", seed: int = 0) -> DataFrame:
    """(replicate, o, e, w): genes by counts; replicate 0 has each once, the others draw genes as often as a Poisson bootstrap of their integer key says. Genes without a positive expectation are left out."""
    rows = genes.where(F.col(observed).isNotNull() & (F.col(expected) > 0)).select(key, F.col(observed).cast("double").alias("o"), F.col(expected).cast("double").alias("e"))
    found = rows.select(F.lit(0).alias("replicate"), "o", "e", F.lit(1).alias("w"))
    if replicates:
        drawn = sets.bootstrap(rows, key, replicates, seed).select((F.col("round") + 1).alias("replicate"), "o", "e", F.col("times").alias("w"))
        found = found.unionByName(drawn)
    return stored(found.groupBy("replicate", "o", "e").agg(F.sum("w").alias("w")), "histogram")


def responsibility(o: Column, e: Column, phi: Column, low: Column, high: Column) -> Column:
    """Posterior probability of the low rate given a count and its expectation."""
    log_ratio = F.log(phi) - F.log(1 - phi) + o * (F.log(low) - F.log(high)) - e * (low - high)
    return 1 / (1 + F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), log_ratio))))


def em(hist: DataFrame, start: tuple[float, float, float] = (0.3, 0.3, 1.1), steps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(replicate, phi, low, high): maximum-likelihood shares and rates (times the expectation) by expectation and maximisation from one start; low <= high.

    What comes to the driver each step is a row a replicate.
    """
    spark = hist.sparkSession
    params = {r[0]: start for r in hist.select("replicate").distinct().collect()}
    tiny = 1e-9
    for _ in range(steps):
        now = spark.createDataFrame([(k, *map(float, v)) for k, v in params.items()], "replicate int, phi double, low double, high double")
        post = responsibility(F.col("o"), F.col("e"), F.col("phi"), F.col("low"), F.col("high"))
        rows = hist.join(F.broadcast(now), "replicate").select("replicate", "o", "e", "w", post.alias("r"))
        w, r = F.col("w"), F.col("r")
        sums = rows.groupBy("replicate").agg(F.sum(w).alias("w"), F.sum(w * r).alias("r"), F.sum(w * r * F.col("o")).alias("ro"), F.sum(w * r * F.col("e")).alias("re"), F.sum(w * F.col("o")).alias("o"), F.sum(w * F.col("e")).alias("e")).collect()
        new = {x["replicate"]: (min(1 - tiny, max(tiny, x["r"] / x["w"])), max(tiny, x["ro"] / max(x["re"], tiny)), max(tiny, (x["o"] - x["ro"]) / max(x["e"] - x["re"], tiny))) for x in sums}
        moved = max((abs(a - b) for k in new for a, b in zip(new[k], params[k])), default=0.0)
        params = new
        if moved < tolerance:
            break
    turned = [(k, *((p, a, b) if a <= b else (1 - p, b, a))) for k, (p, a, b) in params.items()]
    return spark.createDataFrame([(k, float(p), float(a), float(b)) for k, p, a, b in turned], "replicate int, phi double, low double, high double")


def parameters(fits: DataFrame) -> DataFrame:
    """Add the model's names: ``false_rate`` = high - 1 and ``penetrance`` = 1 - low / high."""
    return fits.withColumns({"false_rate": F.col("high") - 1, "penetrance": 1 - F.col("low") / F.col("high")})


def log_likelihood(hist: DataFrame, fits: DataFrame) -> DataFrame:
    """(replicate, loglik) of the mixture at the fitted parameters."""
    rows = hist.join(F.broadcast(fits.select("replicate", "phi", "low", "high")), "replicate")
    part = lambda share, rate: F.log(share) + F.col("o") * F.log(F.col("e") * rate) - F.col("e") * rate
    a, b = part(F.col("phi"), F.col("low")), part(1 - F.col("phi"), F.col("high"))
    top = F.greatest(a, b)
    from helixframe.operators.models import _log_factorial

    each = top + F.log(F.exp(a - top) + F.exp(b - top)) - _log_factorial("o")
    return rows.withColumn("_l", each).groupBy("replicate").agg(F.sum(F.col("w") * F.col("_l")).alias("loglik"))


def _mean_cdf(hist: DataFrame, tries: list[tuple[float, float, float]], locations: int) -> np.ndarray:
    """Mean over genes of the mixture's distribution function at 0 .. locations - 1, a row a try of (phi, low, high)."""
    at = np.arange(locations)

    def cdf(batches):
        for pdf in batches:
            out = np.zeros((len(tries), locations))
            for e, w in zip(pdf["e"], pdf["w"]):
                for k, (phi, low, high) in enumerate(tries):
                    out[k] += w * (phi * (1 - dist.poisson_sf(at + 1, e * low)) + (1 - phi) * (1 - dist.poisson_sf(at + 1, e * high)))
            yield pd.DataFrame({"k": np.repeat(np.arange(len(tries)), locations), "o": np.tile(at, len(tries)), "p": out.ravel(), "w": float(pdf["w"].sum()) / locations / len(tries)})

    weights = hist.where("replicate = 0").groupBy("e").agg(F.sum("w").cast("double").alias("w"))
    sums = weights.mapInPandas(cdf, "k int, o int, p double, w double").groupBy("k", "o").agg(F.sum("p").alias("p"), F.sum("w").alias("w")).collect()
    out, total = np.zeros((len(tries), locations)), 0.0
    for r in sums:
        out[r["k"], r["o"]] = r["p"]
        total += r["w"]
    return out / max(total, 1e-300)


def cdf_fit(hist: DataFrame, start: tuple[float, float, float] = (0.3, 0.3, 1.1), steps: int = 30) -> DataFrame:
    """(replicate 0, phi, low, high, error) whose distribution function lies closest to the observed counts', in squares over the observed values: damped Gauss-Newton,
    a step's function values and slopes in one pass over the histogram of expectations."""
    spark = hist.sparkSession
    counts = hist.where("replicate = 0").groupBy("o").agg(F.sum("w").alias("w")).orderBy("o").collect()  # a row an observed count
    if not counts:
        return spark.createDataFrame([], "replicate int, phi double, low double, high double, error double")
    at = np.array([int(r["o"]) for r in counts])
    want = np.cumsum([r["w"] for r in counts]) / sum(r["w"] for r in counts)
    low, high = np.array([1e-4, 1e-4, 1e-4]), np.array([1 - 1e-4, 50.0, 50.0])
    now, damp, h, best = np.clip(np.array(start), low, high), 1e-3, 1e-5, None
    for _ in range(steps):
        tries = [tuple(now)] + [tuple(now + h * np.eye(3)[i]) for i in range(3)]
        values = _mean_cdf(hist, tries, int(at.max()) + 1)[:, at]
        rest, slope = want - values[0], (values[1:] - values[0]) / h
        error = float(rest @ rest)
        if best is None or error < best[0]:
            done = best is not None and best[0] - error < 1e-14 + 1e-9 * best[0]
            best, damp = (error, now, slope, rest), damp / 5
            if done:
                break
        else:
            damp *= 10
            if damp > 1e8:
                break
        error, base, slope, rest = best
        a = slope @ slope.T
        now = np.clip(base + np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-9), slope @ rest), low, high)
    error, (phi, x, y) = best[0], best[1]
    row = (phi, x, y) if x <= y else (1 - phi, y, x)
    return spark.createDataFrame([(0, *map(float, row), error)], "replicate int, phi double, low double, high double, error double")


def posteriors(genes: DataFrame, fits: DataFrame, observed: str, expected: str) -> DataFrame:
    """Genes with ``p_insufficient`` at the fit of replicate 0; null without a positive expectation."""
    one = fits.where("replicate = 0").select(F.col("phi").alias("_phi"), F.col("low").alias("_low"), F.col("high").alias("_high"))  # one row
    post = responsibility(F.col(observed).cast("double"), F.col(expected).cast("double"), F.col("_phi"), F.col("_low"), F.col("_high"))
    return genes.crossJoin(F.broadcast(one)).withColumn("p_insufficient", F.when(F.col(expected) > 0, post)).drop("_phi", "_low", "_high")


def poisson_draw(u: Column, mean: Column) -> Column:
    """The least count whose distribution function reaches u: a Poisson draw from a uniform number."""

    @pandas_udf(T.LongType())
    def drawn(us: pd.Series, means: pd.Series) -> pd.Series:
        x, m = us.to_numpy(float), means.to_numpy(float)
        count, term = np.zeros(len(x), np.int64), np.exp(-m)
        total, k = term.copy(), 0
        while (open_ := total < x).any() and k < 10_000:
            k += 1
            term = term * m / k
            count[open_] = k
            total = total + term
            if k > m.max() and term.max() < 1e-17:
                break
        return pd.Series(count)

    return drawn(u, mean)


def simulate(genes: DataFrame, key: str, expected: str, phi: float, false_rate: float, penetrance: float, seed: int = 0) -> DataFrame:
    """Genes with ``insufficient`` and ``simulated`` counts of the model, by hash numbers of an integer key: the same whatever the partitions."""
    first, second = sets.hash_uniform(F.col(key) * 7 + 1, seed), sets.hash_uniform(F.col(key) * 16807 % 2147483647 + 5, seed + 77)
    sick = first < phi
    mean = F.col(expected) * (1 + false_rate) * F.when(sick, 1 - penetrance).otherwise(1.0)
    return genes.withColumns({"insufficient": sick, "simulated": poisson_draw(second, mean)})


def truncated_genes(hist: DataFrame, fits: DataFrame, shares: list[float]) -> DataFrame:
    """(replicate, share, insufficient, sufficient): how many genes of each kind the fit foretells with at least one truncation if only a share of the sample had been seen."""
    at = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    rows = hist.join(F.broadcast(fits.select("replicate", "phi", "low", "high")), "replicate").select("*", at)
    some = lambda rate: 1 - F.exp(-F.col("e") * F.col("share") * rate)
    return rows.groupBy("replicate", "share").agg(F.sum(F.col("w") * F.col("phi") * some(F.col("low"))).alias("insufficient"), F.sum(F.col("w") * (1 - F.col("phi")) * some(F.col("high"))).alias("sufficient"))


def estimate(genes: DataFrame, key: str, observed: str, expected: str, replicates: int = 0, seed: int = 0) -> DataFrame:
    """The driver: (parameter, value, low, high) of the mixture on all genes, with the 2.5 and 97.5 percentiles over bootstrap replicates (null without)."""
    hist = histogram(genes, observed, expected, replicates, key, seed)
    fits = parameters(em(hist))
    long = fits.select("replicate", F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).alias("v")) for c in ("phi", "false_rate", "penetrance")])).alias("p")).select("replicate", "p.*")
    return long.groupBy("parameter").agg(F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("value"), F.percentile(F.when(F.col("replicate") > 0, F.col("v")), 0.025).alias("low"), F.percentile(F.when(F.col("replicate") > 0, F.col("v")), 0.975).alias("high"))
