"""Queries: genotype recoding, frequencies, merging, correlation and relatedness on dosages derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import genotype
from helixframe.sources.tables import table


def _calls(rows, ind):
    x = F.col("l_orderkey")
    rows = rows.groupBy(F.col("l_partkey").alias("marker"), ind.alias("ind")).agg(F.max("l_orderkey").alias("l_orderkey"))
    return rows.select("marker", "ind", F.when(x % 17 != 0, (x * 7919 % 201) / 100.0).alias("dosage"))


def dosages(spark, d):
    """marker = part, individual = supplier, dosage from the greatest order key of their line items, missing every 17th."""
    return _calls(table(spark, d, "lineitem"), F.col("l_suppkey"))


def nation_dosages(spark, d):
    """The same with the suppliers' nations as individuals, for formats with a column an individual."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _calls(li, F.col("s_nationkey").cast("long"))


def recode_models(spark, d):
    return dosages(spark, d).select("marker", "ind", *[F.round(genotype.recode(F.col("dosage"), m), 6).alias(m.lower()) for m in ("ADD", "DOM", "REC", "HETADV", "IMPERROR")])


def maf_summary(spark, d):
    return genotype.summary(dosages(spark, d), "marker", "dosage").select("marker", "n", "missing", *[F.round(c, 11).alias(c) for c in ("sum", "freq", "maf")])


def missing_report(spark, d):
    return genotype.missing_report(dosages(spark, d), "ind", "dosage").select("ind", "n", "missing", F.round("share", 6).alias("share"))


def maf_filter(spark, d):
    return genotype.filter_maf(dosages(spark, d), "marker", "dosage", 0.480003).select("marker", "ind", F.round("dosage", 4).alias("dosage"))


def _halves(spark, d):
    g = dosages(spark, d).withColumns({"a1": F.lit("A"), "a2": F.lit("C")})
    first = g.where("(marker + ind) % 3 <> 0")
    second = g.where("(marker + ind) % 3 <> 1").withColumns({"dosage": 2 - F.col("dosage"), "a2": F.when(F.col("marker") % 5 == 0, "G").otherwise("C")})
    return first, second


def dosage_merge(spark, d):
    merged, _ = genotype.merge(_halves(spark, d), "marker", "ind", "dosage", "a1", "a2")
    return merged.select("marker", "ind", F.round("dosage", 4).alias("dosage"), "a1", "a2")


def merge_mismatches(spark, d):
    _, report = genotype.merge(_halves(spark, d), "marker", "ind", "dosage", "a1", "a2")
    return report.select("marker", F.array_join("alleles", ",").alias("alleles"))


def pairwise_r2(spark, d):
    """Every marker with the twenty after it."""
    g = dosages(spark, d)
    a = g.select(F.col("marker").alias("a")).distinct()
    pairs = a.select("a", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 20)).alias("b"))
    return genotype.pairwise_r2(g, "marker", "ind", "dosage", pairs).select("a", "b", "n", F.round("r2", 6).alias("r2"))


def gram_matrix(spark, d):
    return genotype.gram(dosages(spark, d), "marker", "ind", "dosage").select("i", "j", "n", F.round("value", 6).alias("value"))


def duplicate_report(spark, d):
    return genotype.duplicates(table(spark, d, "orders"), "o_custkey")


def mean_impute(spark, d):
    return genotype.mean_impute(dosages(spark, d), ["marker"], "dosage").select("marker", "ind", F.round("dosage", 11).alias("dosage"))


def phenotype_summary(spark, d):
    c = table(spark, d, "customer").withColumn("phenotype", F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 3))
    return genotype.phenotype_summary(c, "phenotype")


def orient_dosage(spark, d):
    g = dosages(spark, d).withColumns({"a1": F.when(F.col("marker") % 2 == 0, "A").otherwise("C"), "variant": F.lit("A")})
    return genotype.orient(g, "a1", "variant", "dosage").select("marker", "ind", F.round("dosage", 4).alias("dosage"))


QUERIES = {f.__name__: f for f in (recode_models, maf_summary, missing_report, maf_filter, dosage_merge, merge_mismatches, pairwise_r2, gram_matrix, duplicate_report, mean_impute, phenotype_summary, orient_dosage)}

_X = "SELECT marker, ind, CASE WHEN x % 17 <> 0 THEN CAST((x * 7919 % 201) / 100.0 AS DOUBLE) END AS dosage FROM k)"
_G = "WITH k AS (SELECT l_partkey AS marker, l_suppkey AS ind, max(l_orderkey) AS x FROM lineitem GROUP BY 1, 2), g AS (" + _X
_N = "WITH k AS (SELECT l_partkey AS marker, CAST(s_nationkey AS BIGINT) AS ind, max(l_orderkey) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), g AS (" + _X
_M = _G + ", m AS (SELECT marker, sum(dosage) AS s, count(dosage) AS n, count(*) - count(dosage) AS missing, sum(dosage) / (2 * count(dosage)) AS freq FROM g GROUP BY 1)"
_H = _G + ", h AS (SELECT marker, ind, dosage, 'A' AS a1, 'C' AS a2, 0 AS i FROM g WHERE (marker + ind) % 3 <> 0 UNION ALL SELECT marker, ind, 2 - dosage, 'A', CASE WHEN marker % 5 = 0 THEN 'G' ELSE 'C' END, 1 FROM g WHERE (marker + ind) % 3 <> 1)"
ORACLES = {
    "recode_models": _G + " SELECT marker, ind, round(dosage, 6) AS add, CASE WHEN dosage IS NOT NULL THEN CASE WHEN floor(dosage + 0.5) >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS dom, CASE WHEN dosage IS NOT NULL THEN CASE WHEN floor(dosage + 0.5) = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS rec, CASE WHEN dosage IS NOT NULL THEN CASE WHEN floor(dosage + 0.5) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS hetadv, round(abs(dosage - floor(dosage + 0.5)), 6) AS imperror FROM g",
    "maf_summary": _M + " SELECT marker, n, missing, round(s, 11) AS sum, round(freq, 11) AS freq, round(least(freq, 1 - freq), 11) AS maf FROM m",
    "missing_report": _G + " SELECT ind, count(*) AS n, count(*) - count(dosage) AS missing, round((count(*) - count(dosage)) / CAST(count(*) AS DOUBLE), 6) AS share FROM g GROUP BY 1",
    "maf_filter": _M + " SELECT marker, ind, round(dosage, 4) AS dosage FROM g WHERE marker IN (SELECT marker FROM m WHERE least(freq, 1 - freq) BETWEEN 0.480003 AND 0.5)",
    "dosage_merge": _H + ", f AS (SELECT marker, arg_min(a1, i) AS a1, arg_min(a2, i) AS a2 FROM h GROUP BY 1) SELECT marker, ind, round(arg_min(dosage, i) FILTER (dosage IS NOT NULL), 4) AS dosage, f.a1, f.a2 FROM h JOIN f USING (marker) GROUP BY marker, ind, f.a1, f.a2",
    "merge_mismatches": _H + " SELECT marker, array_to_string(list_sort(list(DISTINCT a1 || '/' || a2)), ',') AS alleles FROM h GROUP BY 1 HAVING count(DISTINCT a1 || '/' || a2) > 1",
    "pairwise_r2": _G + " SELECT a.marker AS a, b.marker AS b, count(*) AS n, CASE WHEN min(a.dosage) < max(a.dosage) AND min(b.dosage) < max(b.dosage) THEN round(pow(corr(a.dosage, b.dosage), 2), 6) END AS r2 FROM g a JOIN g b ON a.ind = b.ind AND b.marker BETWEEN a.marker + 1 AND a.marker + 20 AND a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY 1, 2",
    "gram_matrix": _M + ", z AS (SELECT marker, ind, (dosage - 2 * freq) / sqrt(2 * freq * (1 - freq)) AS z FROM g JOIN m USING (marker) WHERE dosage IS NOT NULL AND least(freq, 1 - freq) > 0) SELECT a.ind AS i, b.ind AS j, count(*) AS n, round(sum(a.z * b.z) / count(*), 6) AS value FROM z a JOIN z b ON a.marker = b.marker AND a.ind >= b.ind GROUP BY 1, 2",
    "duplicate_report": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "mean_impute": _G + " SELECT marker, ind, round(coalesce(dosage, avg(dosage) OVER (PARTITION BY marker)), 11) AS dosage FROM g",
    "phenotype_summary": "SELECT count_if(p = 1)::BIGINT AS controls, count_if(p = 2)::BIGINT AS cases, count_if(p IS NULL OR p NOT IN (1, 2))::BIGINT AS missing FROM (SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 3 END AS p FROM customer)",
    "orient_dosage": _G + " SELECT marker, ind, round(CASE WHEN marker % 2 = 0 THEN dosage ELSE 2 - dosage END, 4) AS dosage FROM g",
}
