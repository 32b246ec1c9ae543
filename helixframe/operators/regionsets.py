"""Region sets against phenotypes with p-values: the global test and the burden test, beside covariates.

The global test asks whether a set's markers X explain what covariates Z leave of a phenotype y. With M = I - Z (Z'Z)^-1 Z' its statistic is
S = |X'My|^2 / y'My, and under the null P(S > s) = P(sum of lambda_i chi2_1 > 0) with lambda the eigenvalues of MXX'M - s M: those of the set's kernel
X'MX less s, and -s for what is left of the space. The kernel is a sum of products over individuals, made in the set's own task
from its dosages; pairs of markers are never rows, and no matrix of individuals is built. A set's kernel, its markers squared, is one group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from helixframe.functions import numeric
from helixframe.operators import covariates as cov
from helixframe.operators import intervals, scans
from helixframe.session import stored


def set_members(df: DataFrame, regions: DataFrame, by: str, pos: str, region: str, marker: str, dosage: str, weight: str = "flat", bin_width: int = 10_000) -> DataFrame:
    """(set, marker, weight): markers of long rows within any region of the set, weighted by their allele frequency."""
    sites = df.select(by, pos, marker).distinct()
    inside = intervals.points_in(sites, regions, by, pos, bin_width).select(F.col(region).alias("set"), marker).distinct()
    freq = df.groupBy(marker).agg((F.avg(dosage) / 2).alias("_f")).where(F.col("_f").isNotNull()).select(marker, scans.marker_weights(F.col("_f"), weight).alias("weight"))
    return inside.join(freq, marker).where(F.col("weight").isNotNull())


def set_rows(df: DataFrame, people: DataFrame, members: DataFrame, marker: str, individual: str, dosage: str, phenotypes: Sequence[str], covariates: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What kernels are made of: (set, phenotype, marker, individual, d), weighted dosages less their mean, and (set, phenotype, marker, w, c, ac, u, n, k, rss0), a row a marker, also of those that nobody is known of, with u = sqrt(w) x'My."""
    k = 1 + len(covariates)
    fixed = cov.fixed_part(people, phenotypes, covariates)
    sums = cov.marker_sums(df, people, marker, individual, dosage, phenotypes, covariates, fixed)
    around = F.zip_with("b", "zsum", lambda v, z: v - z * F.col("mean"))  # Z' of the dosages less their mean
    sums = sums.withColumn("c", around)
    u = (F.col("xy") - F.col("mean") * F.col("sy")) - cov._dot(cov._times(F.col("inverse"), F.col("c"), k), F.col("zy"))
    sums = stored(sums.select("phenotype", marker, "mean", "c", cov._times(F.col("inverse"), F.col("c"), k).alias("ac"), u.alias("u"), "n", "rss0"), "sums")
    who = cov.long_people(people, individual, phenotypes, covariates)
    met = members.select("set", F.col(marker).alias("marker"), F.sqrt("weight").alias("w")).join(sums.withColumnRenamed(marker, "marker"), "marker")
    rows = df.where(F.col(dosage).isNotNull()).select(F.col(marker).alias("marker"), F.col(individual).alias("individual"), F.col(dosage).cast("double").alias("_x"))
    rows = rows.join(members.select(F.col(marker).alias("marker")).distinct(), "marker", "left_semi").join(who.withColumnRenamed(individual, "individual"), "individual")
    rows = rows.join(met.select("set", "phenotype", "marker", "mean", "w"), ["phenotype", "marker"])
    rows = rows.select("set", "phenotype", "marker", "individual", ((F.col("_x") - F.col("mean")) * F.col("w")).alias("d"))
    return rows, met.select("set", "phenotype", "marker", "w", "c", "ac", (F.col("u") * F.col("w")).alias("u"), "n", F.lit(k).alias("k"), "rss0")


def add_products(kernel: np.ndarray, marker: np.ndarray, individual: np.ndarray, d: np.ndarray, most: int = 1 << 21) -> None:
    """Add the products of every two entries of an individual to its markers' cells: by blocks of dense columns or entry by entry, whichever is less work; at most about ``most`` numbers are held beside the kernel."""
    order = np.argsort(individual, kind="stable")
    marker, d = marker[order], d[order]
    _, first, inverse, n = np.unique(individual[order], return_index=True, return_inverse=True, return_counts=True)
    if len(kernel) ** 2 * len(n) < 200 * float((n.astype(float) ** 2).sum()):
        wide = max(1, most // max(1, len(kernel)))
        for start in range(0, len(n), wide):
            block = slice(first[start], first[start + wide] if start + wide < len(n) else len(d))
            dense = np.zeros((len(kernel), min(wide, len(n) - start)))
            np.add.at(dense, (marker[block], inverse[block] - start), d[block])
            kernel += dense @ dense.T
        return
    each = n[inverse]  # an entry meets all entries of its individual
    ends = np.cumsum(each)
    start = 0
    while start < len(d):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        some = each[start:end]
        left = np.repeat(np.arange(start, end), some)
        right = np.repeat(first[inverse[start:end]] - (np.cumsum(some) - some), some) + np.arange(len(left))
        np.add.at(kernel, (marker[left], marker[right]), d[left] * d[right])
        start = end


def global_p(kernel: np.ndarray, u: np.ndarray, rss0: float, n: int, k: int) -> tuple[float, float, float]:
    """(S, S over the kernel's trace, p) of a set; NaN where the markers or the phenotype do not vary beside the covariates."""
    trace = float(np.trace(kernel))
    if not (rss0 > 0 and trace > 1e-12):
        return np.nan, np.nan, np.nan
    s = float(u @ u) / rss0
    space = n - k
    values = np.maximum(np.linalg.eigvalsh(kernel)[::-1][:space], 0)
    return s, s / trace, numeric.weighted_chi_square_tail(0.0, np.concatenate([values - s, np.full(max(0, space - len(values)), -s)]))


def global_test(df: DataFrame, people: DataFrame, members: DataFrame, marker: str, individual: str, dosage: str, phenotypes: Sequence[str], covariates: Sequence[str] = ()) -> DataFrame:
    """(set, phenotype, n_markers, n, statistic, scaled, p) of the global test for linear phenotypes; unknown dosages stand at the marker's mean."""

    def test(entries: pa.Table, markers: pa.Table) -> pa.Table:
        names = pa.array(sorted(markers["marker"].to_pylist()))
        of = lambda t: pc.index_in(t["marker"], names.cast(t.schema.field("marker").type)).to_numpy()
        at = of(markers)
        kernel = np.zeros((len(names), len(names)))
        if entries.num_rows:
            add_products(kernel, of(entries), entries["individual"].combine_chunks().dictionary_encode().indices.to_numpy(), entries["d"].to_numpy())
        c, ac = (np.array(markers[f].to_pylist(), float).reshape(len(names), -1)[np.argsort(at)] for f in ("c", "ac"))
        w, u = (markers[f].to_numpy()[np.argsort(at)] for f in ("w", "u"))
        for i in range(0, len(names), 256):
            kernel[i : i + 256] -= w[i : i + 256, None] * w * (c[i : i + 256] @ ac.T)
        one = markers.slice(0, 1).to_pylist()[0]
        s, scaled, p = global_p(kernel, u, float(one["rss0"]), int(one["n"]), int(one["k"]))
        return pa.table([[v] for v in (one["set"], one["phenotype"], len(names), int(one["n"]), s, scaled, p)], schema=pa.schema([("set", markers.schema.field("set").type), ("phenotype", markers.schema.field("phenotype").type), ("n_markers", pa.int64()), ("n", pa.int64()), ("statistic", pa.float64()), ("scaled", pa.float64()), ("p", pa.float64())]))

    by = ["set", "phenotype"]
    rows, known = set_rows(df, people, members, marker, individual, dosage, phenotypes, covariates)
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: as many tasks whatever the bytes
    met = rows.repartition(parts, *by).groupBy(*by).cogroup(known.repartition(parts, *by).groupBy(*by))
    kind = dict(known.dtypes)["set"]
    got = met.applyInArrow(test, f"set {kind}, phenotype string, n_markers long, n long, statistic double, scaled double, p double")
    return got.select("set", "phenotype", "n_markers", "n", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("statistic", "scaled", "p")])


def burden_test(df: DataFrame, people: DataFrame, members: DataFrame, marker: str, individual: str, dosage: str, phenotypes: Sequence[str], covariates: Sequence[str] = ()) -> DataFrame:
    """(set, phenotype, n, beta, se, p) of an individual's weighted sum of dosages less the markers' means, beside covariates."""
    mean = df.groupBy(marker).agg(F.avg(dosage).alias("_m"))
    rows = df.where(F.col(dosage).isNotNull()).join(mean, marker).join(members, marker)
    sums = rows.groupBy("set", individual).agg(F.sum(F.col("weight") * (F.col(dosage) - F.col("_m"))).alias("_burden"))
    return cov.covariate_scan(sums, people, "set", individual, "_burden", phenotypes, covariates, unknown="zero").select("phenotype", "set", "n", "beta", "se", "p")


def region_set_pvalues(df: DataFrame, people: DataFrame, members: DataFrame, marker: str, individual: str, dosage: str, phenotypes: Sequence[str], covariates: Sequence[str] = ()) -> DataFrame:
    """Set by phenotype by test: (set, phenotype, test, n, statistic, p); the global test's statistic is S, the burden test's its slope."""
    cols = ["set", "phenotype", "test", "n", "statistic", "p"]
    first = global_test(df, people, members, marker, individual, dosage, phenotypes, covariates).withColumn("test", F.lit("global"))
    second = burden_test(df, people, members, marker, individual, dosage, phenotypes, covariates).withColumn("test", F.lit("burden")).withColumn("statistic", F.col("beta"))
    return first.select(*cols).unionByName(second.select(*cols))
