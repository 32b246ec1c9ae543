"""Marker scans with covariates: what the covariates share is worked out once, each marker adds its own row.

With Z the intercept and covariates, A = Z'Z is inverted once a phenotype. A marker x needs only b = Z'x, x'x and x'y,
sums over its known dosages; the Schur complement s = x'x - b'A^-1 b gives its slope (x'y - b'A^-1 Z'y) / s
and the residual sum of squares falls by slope^2 s from that of the covariates alone. No marker's
design matrix is ever built, and any number of markers is one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.functions import dist


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _times(flat: Column, v: Column, k: int) -> Column:
    """A k x k matrix, row after row in one array, times a vector."""
    return F.array(*[_dot(F.slice(flat, i * k + 1, k), v) for i in range(k)])


def fixed_part(people: DataFrame, phenotypes: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """A row a phenotype: n, A^-1 (row after row), Z'1.. as ``zsum``, Z'y, y'y, the sum of y, and the residual sum of squares of the covariates alone.

    A phenotype uses the individuals that know it and all covariates. Singular covariates raise an error that names the phenotype.
    """
    spark, k = people.sparkSession, 1 + len(covariates)
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    sums = [F.sum(a * b) for i, a in enumerate(z) for b in z[i:]]
    out = []
    for p in phenotypes:
        y = F.col(p).cast("double")
        r = people.dropna(subset=[p, *covariates]).agg(F.count("*").alias("n"), F.array(*sums).alias("a"), F.array(*[F.sum(c) for c in z]).alias("zsum"), F.array(*[F.sum(c * y) for c in z]).alias("zy"), F.sum(y * y).alias("yy"), F.sum(y).alias("sy")).first()
        if not r["n"]:
            continue
        a = np.zeros((k, k))
        a[np.triu_indices(k)] = r["a"]
        a += np.triu(a, 1).T
        scale = np.sqrt(np.diag(a))
        if not (scale > 0).all() or np.linalg.matrix_rank(a / np.outer(scale, scale), tol=1e-9) < k:
            raise ValueError(f"the covariates are collinear for phenotype {p}")
        inverse, zy = np.linalg.inv(a), np.array(r["zy"])
        out.append((p, r["n"], [float(v) for v in inverse.ravel()], [float(v) for v in r["zsum"]], [float(v) for v in zy], float(r["yy"]), float(r["sy"]), float(max(0.0, r["yy"] - zy @ inverse @ zy))))
    return spark.createDataFrame(out, "phenotype string, n long, inverse array<double>, zsum array<double>, zy array<double>, yy double, sy double, rss0 double")


def marker_sums(df: DataFrame, people: DataFrame, marker: str, individual: str, dosage: str, phenotypes: Sequence[str], covariates: Sequence[str], fixed: DataFrame, unknown: str = "mean") -> DataFrame:
    """A row a phenotype and marker: known dosages ``calls``, their mean (0 where ``unknown`` is zero), and over all individuals of the phenotype (unknown dosages at that mean) b = Z'x, x'x and x'y, with the row of ``fixed``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("phenotype"), F.col(p).cast("double").alias("_y")) for p in phenotypes])).alias("_p")
    who = people.dropna(subset=list(covariates)).select(individual, *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(covariates, 1)], pairs)
    who = who.select(individual, *[f"_z{i}" for i in range(1, 1 + len(covariates))], "_p.*").where(F.col("_y").isNotNull())
    rows = df.where(F.col(dosage).isNotNull()).select(marker, individual, F.col(dosage).cast("double").alias("_x")).join(who, individual)
    z = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(1, 1 + len(covariates))]]
    x = F.col("_x")
    got = rows.groupBy("phenotype", marker).agg(F.count("*").alias("calls"), F.array(*[F.sum(c) for c in z]).alias("_zk"), F.array(*[F.sum(c * x) for c in z]).alias("_zx"), F.sum(x * x).alias("_xx"), F.sum(x * F.col("_y")).alias("_xy"), F.sum("_y").alias("_yk"))
    got = got.join(F.broadcast(fixed), "phenotype")  # a row a phenotype
    mean = F.col("_zx")[0] / F.col("calls") if unknown == "mean" else F.lit(0.0)
    got = got.withColumn("mean", mean)
    rest = F.zip_with("zsum", "_zk", lambda a, b: a - b)
    b = F.zip_with("_zx", rest, lambda v, r: v + r * F.col("mean"))
    return got.withColumns({"b": b, "xx": F.col("_xx") + (F.col("n") - F.col("calls")) * F.col("mean") * F.col("mean"), "xy": F.col("_xy") + (F.col("sy") - F.col("_yk")) * F.col("mean")}).drop("_zk", "_zx", "_xx", "_xy", "_yk")


def long_people(people: DataFrame, individual: str, phenotypes: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """(individual, phenotype) of those who know the phenotype and all covariates."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("phenotype"), F.col(p).isNotNull().alias("_in")) for p in phenotypes])).alias("_p")
    return people.dropna(subset=list(covariates)).select(individual, pairs).where("_p._in").select(individual, "_p.phenotype")


def covariate_scan(df: DataFrame, people: DataFrame, marker: str, individual: str, dosage: str, phenotypes: Sequence[str], covariates: Sequence[str] = (), unknown: str = "mean") -> DataFrame:
    """Every phenotype on every marker beside the covariates: (phenotype, marker, n, calls, beta, se, t, p, r2), df = n - 2 as in ``models.ols``.

    ``df``: a row a marker and individual; ``people``: a row an individual with phenotypes and covariates. Individuals without a
    row, or with a null dosage, stand at the marker's mean (or, ``unknown`` zero, at 0). Nulls where a marker does not vary beside the covariates.
    """
    k = 1 + len(covariates)
    fixed = fixed_part(people, phenotypes, covariates)
    got = marker_sums(df, people, marker, individual, dosage, phenotypes, covariates, fixed, unknown)
    got = got.withColumn("_ab", _times(F.col("inverse"), F.col("b"), k))
    s = F.col("xx") - _dot(F.col("b"), F.col("_ab"))
    got = got.withColumn("_s", F.when(s > 1e-9 * F.col("xx"), s)).withColumn("beta", (F.col("xy") - _dot(F.col("_ab"), F.col("zy"))) / F.col("_s"))
    rss = F.greatest(F.lit(0.0), F.col("rss0") - F.col("beta") * F.col("beta") * F.col("_s"))
    got = got.withColumn("_rss", F.when(F.col("beta").isNotNull(), rss)).withColumn("se", F.when(F.col("n") > 2, F.sqrt(F.col("_rss") / (F.col("n") - 2) / F.col("_s"))))
    t = F.try_divide("beta", "se")
    tss = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    got = got.withColumns({"t": t, "r2": F.when(tss > 0, 1 - F.col("_rss") / tss)})
    return got.select("phenotype", marker, "n", "calls", "beta", "se", "t", (2 * dist.t_upper(F.abs("t"), (F.col("n") - 2).cast("double"))).alias("p"), "r2")
