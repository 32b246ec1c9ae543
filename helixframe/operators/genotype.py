"""Genotype rows: long form (marker, individual, dosage of allele 1 in [0, 2], null where missing)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def recode(dosage: Column, model: str) -> Column:
    """ADD: as is; DOM: carriers; REC: two copies; HETADV: exactly one copy by nearest class; IMPERROR: distance from the nearest whole dosage. Null and out-of-range stay null."""
    sound = F.when((dosage >= 0) & (dosage <= 2), dosage)
    nearest = F.floor(sound + 0.5)
    return {
        "ADD": sound,
        "DOM": F.when(sound.isNotNull(), (nearest >= 1).cast("double")),
        "REC": F.when(sound.isNotNull(), (nearest == 2).cast("double")),
        "HETADV": F.when(sound.isNotNull(), (nearest == 1).cast("double")),
        "IMPERROR": F.abs(sound - nearest),
    }[model]


def summary(df: DataFrame, marker: str, dosage: str) -> DataFrame:
    """Per marker: sum, count, missing, allele frequency and folded maf."""
    got = df.groupBy(marker).agg(F.sum(dosage).alias("sum"), F.count(dosage).alias("n"), F.count_if(F.col(dosage).isNull()).alias("missing"))
    freq = F.when(F.col("n") > 0, F.col("sum") / (2 * F.col("n")))
    return got.withColumn("freq", freq).withColumn("maf", F.least("freq", 1 - F.col("freq")))


def vcf_alt_rate(het: Column, hom: Column, n: Column, no_call: Column) -> Column:
    """(2 homVar + het) / (N - noCall): neither halved nor folded."""
    return F.when(n > no_call, (2 * hom + het) / (n - no_call))


def missing_report(df: DataFrame, unit: str, dosage: str) -> DataFrame:
    """Missing count and share per marker or per individual."""
    return df.groupBy(unit).agg(F.count("*").alias("n"), F.count_if(F.col(dosage).isNull()).alias("missing")).withColumn("share", F.col("missing") / F.col("n"))


def filter_maf(df: DataFrame, marker: str, dosage: str, low: float, high: float = 0.5) -> DataFrame:
    """Rows of the markers whose folded maf lies in [low, high]."""
    keep = summary(df, marker, dosage).where(F.col("maf").between(low, high)).select(marker)
    return df.join(keep, marker, "left_semi")


def merge(parts: Sequence[DataFrame], marker: str, individual: str, dosage: str, a1: str, a2: str) -> tuple[DataFrame, DataFrame]:
    """Merged rows and mismatch report of several inputs with alleles.

    A dosage is the first non-missing one in input order, the alleles are those
    of the first input that has the marker; markers whose alleles differ are
    reported, not flipped. One aggregation, no joins.
    """
    stacked = None
    for i, part in enumerate(parts):
        one = part.select(marker, individual, dosage, a1, a2).withColumn("_part", F.lit(i))
        stacked = one if stacked is None else stacked.unionByName(one)
    rows = stacked.groupBy(marker, individual).agg(F.min_by(dosage, F.when(F.col(dosage).isNotNull(), F.col("_part"))).alias(dosage))
    alleles = stacked.groupBy(marker).agg(F.min(F.struct("_part", a1, a2)).alias("_a"), F.collect_set(F.concat_ws("/", a1, a2)).alias("_seen"))
    merged = rows.join(alleles, marker).select(marker, individual, dosage, F.col(f"_a.{a1}").alias(a1), F.col(f"_a.{a2}").alias(a2))
    report = alleles.where(F.size("_seen") > 1).select(marker, F.array_sort("_seen").alias("alleles"))
    return merged, report


def flip_to_least(df: DataFrame, a1: str, a2: str, beta: str) -> DataFrame:
    """Effects for the lexicographically lesser allele: rows whose a1 is the greater are negated and their alleles exchanged."""
    flip = F.col(a1) > F.col(a2)
    return df.withColumns({beta: F.when(flip, -F.col(beta)).otherwise(F.col(beta)), a1: F.least(a1, a2), a2: F.greatest(a1, a2)})


def orient(df: DataFrame, a1: str, variant: str, dosage: str) -> DataFrame:
    """Dosage of ``variant``: 2 - d where allele 1 is not it."""
    return df.withColumn(dosage, F.when(F.col(a1) == F.col(variant), F.col(dosage)).otherwise(2 - F.col(dosage)))


def mean_impute(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    mean = df.groupBy(*by).agg(F.avg(value).alias("_m"))
    return df.join(mean, list(by), "left").withColumn(value, F.coalesce(value, "_m")).drop("_m")


def pairwise_r2(df: DataFrame, marker: str, individual: str, dosage: str, pairs: DataFrame | None = None) -> DataFrame:
    """Squared correlation of markers (a < b) over the individuals that both know, null where one does not vary; ``pairs`` (a, b) limits them."""
    rows = df.where(F.col(dosage).isNotNull()).select(marker, individual, dosage)
    a = rows.select(F.col(marker).alias("a"), individual, F.col(dosage).alias("_x"))
    b = rows.select(F.col(marker).alias("b"), individual, F.col(dosage).alias("_y"))
    if pairs is not None:
        a = a.join(pairs, "a")
        j = a.join(b, ["b", individual])
    else:
        j = a.join(b, individual).where("a < b")
    varied = (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return j.groupBy("a", "b").agg(F.when(varied, F.try_divide(F.pow(F.covar_pop("_x", "_y"), 2), F.var_pop("_x") * F.var_pop("_y"))).alias("r2"), F.count("*").alias("n"))


def gram(df: DataFrame, marker: str, individual: str, dosage: str) -> DataFrame:
    """Relatedness (i >= j): mean over shared markers of (x - 2p)(y - 2p) / (2p (1 - p)); markers without variation are left out."""
    p = summary(df, marker, dosage).where("maf > 0").select(marker, "freq")
    z = df.where(F.col(dosage).isNotNull()).join(p, marker).select(marker, individual, ((F.col(dosage) - 2 * F.col("freq")) / F.sqrt(2 * F.col("freq") * (1 - F.col("freq")))).alias("_z"))
    a = z.select(marker, F.col(individual).alias("i"), F.col("_z").alias("_x"))
    b = z.select(marker, F.col(individual).alias("j"), F.col("_z").alias("_y"))
    return a.join(b, marker).where("i >= j").groupBy("i", "j").agg((F.sum(F.col("_x") * F.col("_y")) / F.count("*")).alias("value"), F.count("*").alias("n"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def phenotype_summary(df: DataFrame, phenotype: str) -> DataFrame:
    """Controls (1), cases (2) and missing (null or anything else)."""
    p = F.col(phenotype)
    return df.agg(F.count_if(p == 1).alias("controls"), F.count_if(p == 2).alias("cases"), F.count_if(p.isNull() | ~p.isin(1, 2)).alias("missing"))


def resampled_gram(gram: DataFrame, replica: DataFrame, drawn: str, original: str) -> DataFrame:
    """(replicate.., i, j, n, value) for i >= j: the relatedness among drawn individuals, rows (drawn number, original individual) of ``replica`` and any further columns that tell replicates apart."""
    by = [c for c in replica.columns if c not in (drawn, original)]
    both = gram.select("i", "j", "n", "value").unionByName(gram.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "value")).withColumnsRenamed({"i": "_oi", "j": "_oj"})
    a = replica.select(*by, F.col(drawn).alias("i"), F.col(original).alias("_oi"))
    b = replica.select(*by, F.col(drawn).alias("j"), F.col(original).alias("_oj"))
    met = both.join(a, "_oi")
    return met.join(b, [*by, "_oj"]).where("i >= j").select(*by, "i", "j", "n", "value")


def summarised_replicates(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by.., n, median, iqr, mean, sd) of repeated estimates: exact percentiles by ranges of the values."""
    from helixframe.operators import ranges

    d = df.where(F.col(value).isNotNull())
    shares = ranges.percentiles(d, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    sums = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    keyed = shares.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "median", (F.col("q3") - F.col("q1")).alias("iqr"))
    return sums.join(keyed, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]).select(*by, "n", "median", "iqr", "mean", "sd")
