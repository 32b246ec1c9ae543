"""Association scans over markers, phenotypes, models and region sets, and the recode pipeline, as aggregations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators import genotype, intervals, models, ranges

#: Scales of phenotypes and the model that each asks for.
SCALES = {"linear": "ols", "rank": "ols", "logistic": "logistic", "count": "poisson"}


def fit(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], scale: str) -> DataFrame:
    """Regression by the phenotype's scale: linear, rank (on the middle ranks of y within each group), logistic or count. (by.., term, beta, se, p, n)."""
    if scale == "rank":
        df = df.dropna(subset=[y, *xs])
        ranked = ranges.counted(df, by, y).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(y).alias("_v"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias("_rank"))
        df = df.join(ranked, [*[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col(y) == F.col("_v")]).withColumn(y, F.col("_rank"))
    if SCALES[scale] == "ols":
        got = models.ols(df, by, y, xs)
    else:
        got = models.glm(df, by, y, xs, SCALES[scale])
    return got.select(*by, "term", "beta", "se", "p", "n")


def marker_scan(df: DataFrame, marker: str, dosage: str, phenotypes: Sequence[str], recodings: Sequence[str] = ("ADD",), interaction: str | None = None, interaction_kind: str = "product", covariates: Sequence[str] = ()) -> DataFrame:
    """Every phenotype on every marker under every recoding, in one set of sums: (phenotype, model, marker, term, beta, se, t, p, n).

    ``df``: a row an individual and marker, with phenotypes and covariates. Each fit leaves out its own rows with nulls.
    With an ``interaction`` column its product with the recoded dosage (or, ``dominant``, the product where the
    dosage carries the allele) and the column itself join the terms.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("phenotype"), F.col(p).cast("double").alias("_y")) for p in phenotypes])).alias("_p")
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), genotype.recode(F.col(dosage), m).cast("double").alias("_x")) for m in recodings])).alias("_m")
    keep = [marker, *covariates, *([interaction] if interaction else [])]
    rows = df.select(*keep, dosage, pairs).select("*", kinds).select(*keep, "_p.*", "_m.*")
    terms = ["_x", *covariates]
    if interaction:
        carried = F.col("_x") if interaction_kind == "product" else (F.col("_x") > 0).cast("double")
        rows = rows.withColumn("_xi", carried * F.col(interaction))
        terms += [interaction, "_xi"]
    got = models.ols(rows, ["phenotype", "model", marker], "_y", terms)
    named = F.when(F.col("term") == "_x", "dosage").when(F.col("term") == "_xi", "interaction").otherwise(F.col("term"))
    return got.withColumn("term", named).select("phenotype", "model", marker, "term", "beta", "se", "t", "p", "n")


def marker_weights(frequency: Column, kind: str) -> Column:
    """``flat``, ``variance`` (1 / (p (1 - p))) or ``rare`` (squared Beta(1, 25) density at the minor frequency)."""
    p = F.least(frequency, 1 - frequency)
    return {"flat": F.lit(1.0), "variance": F.try_divide(F.lit(1.0), p * (1 - p)), "rare": F.pow(25 * F.pow(1 - p, F.lit(24)), F.lit(2.0))}[kind]


def region_set_tests(df: DataFrame, regions: DataFrame, by: str, pos: str, region: str, marker: str, individual: str, dosage: str, phenotypes: Sequence[str], weight: str = "flat", bin_width: int = 10_000) -> DataFrame:
    """Every region set against every phenotype: (set, phenotype, n_markers, n, q, burden_slope, burden_r2).

    Markers of ``df`` (a row a marker and individual, with its place and phenotypes) join the regions that hold them. q is the sum
    over markers of weight * (sum of dosage times centred phenotype) squared, over the phenotype's variance; the burden is
    an individual's weighted dosage sum, regressed on by the phenotype. Rows with a null dosage or phenotype are left out.
    """
    sites = df.select(by, pos, marker).distinct()
    inside = intervals.points_in(sites, regions, by, pos, bin_width).select(F.col(region).alias("set"), marker).distinct()
    freq = df.groupBy(marker).agg((F.avg(dosage) / 2).alias("_f")).select(marker, marker_weights(F.col("_f"), weight).alias("_w"))
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("phenotype"), F.col(p).cast("double").alias("_y")) for p in phenotypes])).alias("_p")
    rows = df.select(marker, individual, F.col(dosage).alias("_x"), pairs).select(marker, individual, "_x", "_p.*").dropna(subset=["_x", "_y"])
    rows = rows.join(inside, marker).join(freq, marker)
    people = rows.groupBy("set", "phenotype", individual).agg(F.max("_y").alias("_y"), F.sum(F.col("_w") * F.col("_x")).alias("_b"))
    burden = people.groupBy("set", "phenotype").agg(F.count("*").alias("n"), F.var_pop("_y").alias("_v"), F.avg("_y").alias("_mean"), F.regr_slope("_y", "_b").alias("burden_slope"), F.regr_r2("_y", "_b").alias("burden_r2"))
    sums = rows.groupBy("set", "phenotype", marker).agg(F.sum(F.col("_x") * F.col("_y")).alias("_xy"), F.sum("_x").alias("_sx"), F.max("_w").alias("_w"))
    met = sums.join(burden, ["set", "phenotype"])
    u = F.col("_xy") - F.col("_sx") * F.col("_mean")
    q = met.groupBy("set", "phenotype").agg(F.count("*").alias("n_markers"), F.sum(F.col("_w") * u * u / F.col("_v")).alias("q"))
    return q.join(burden, ["set", "phenotype"]).select("set", "phenotype", "n_markers", "n", "q", "burden_slope", "burden_r2")


def recode_pipeline(df: DataFrame, marker: str, individual: str, dosage: str, least_maf: float, prune: Callable[[DataFrame], DataFrame] | None = None, include: DataFrame | None = None, most_maf: float = 0.5, most_missing: float = 1.0, keep: DataFrame | None = None, individuals: DataFrame | None = None) -> DataFrame:
    """Long dosages through the fixed order of filters: markers of ``least_maf``; pruned (by a function of these rows alone to
    their markers); on the include list; of at most ``most_maf`` and ``most_missing``, or on the keep list; then the listed individuals."""
    counts = df.groupBy(marker).agg((F.avg(dosage) / 2).alias("_f"), (1 - F.count(dosage) / F.count("*")).alias("_miss")).withColumn("_maf", F.least("_f", 1 - F.col("_f")))
    chosen = counts.where(F.col("_maf") >= least_maf)
    if prune is not None:
        chosen = chosen.join(prune(df.join(chosen.select(marker), marker, "left_semi")).select(marker), marker, "left_semi")
    if include is not None:
        chosen = chosen.join(include.select(marker).distinct(), marker, "left_semi")
    fine = (F.col("_maf") <= most_maf) & (F.col("_miss") <= most_missing)
    if keep is not None:
        chosen = chosen.join(keep.select(marker).distinct().withColumn("_keep", F.lit(True)), marker, "left")
        fine = fine | F.coalesce("_keep", F.lit(False))
    rows = df.join(chosen.where(fine).select(marker), marker, "left_semi")
    return rows if individuals is None else rows.join(individuals.select(individual).distinct(), individual, "left_semi")


def dose_response(counts: DataFrame, doses: DataFrame, spike: str, sample: str, n: str, dose: str) -> DataFrame:
    """Per sample the regression of log2 count on log2 dose of its spike-ins: (sample, n_spikes, slope, intercept, r2)."""
    d = counts.where(F.col(n) > 0).join(doses.where(F.col(dose) > 0), spike)
    x, y = F.log2(F.col(dose).cast("double")), F.log2(F.col(n).cast("double"))
    return d.groupBy(sample).agg(F.count("*").alias("n_spikes"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def fold_changes(counts: DataFrame, spike: str, sample: str, n: str) -> DataFrame:
    """log2 ratio of every spike-in's counts between every two samples, a before b; the samples of one spike-in are few."""
    c = counts.where(F.col(n) > 0)
    a, b = c.select(spike, F.col(sample).alias("a"), F.col(n).alias("_x")), c.select(spike, F.col(sample).alias("b"), F.col(n).alias("_y"))
    return a.join(b, spike).where("a < b").select(spike, "a", "b", F.log2(F.col("_y") / F.col("_x")).alias("log2_ratio"))
