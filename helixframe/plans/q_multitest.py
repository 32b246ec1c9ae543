"""Queries: false-discovery control on a pseudo p-value derived from order keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.operators import multitest
from helixframe.sources.tables import table

_P = "(o_orderkey * 48271 % 2147483647) / 2147483647.0"


def pseudo_p(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("o_orderkey") * F.lit(48271) % F.lit(2147483647)).cast("double") / F.lit(2147483647.0)
    return table(spark, d, "orders").select("o_orderkey", (p * p * p).alias("p"))


def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    got = multitest.bh_adjust(pseudo_p(spark, d), "p")
    return got.select("o_orderkey", F.round("p", 9).alias("p"), F.round("p_adj", 9).alias("p_adj"))


def bh_threshold(spark: SparkSession, d: str) -> DataFrame:
    return multitest.bh_threshold(pseudo_p(spark, d), "p", 0.8).select(F.round("threshold", 9).alias("threshold"))


def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return multitest.bonferroni(pseudo_p(spark, d), "p").select("o_orderkey", F.round("p_bonf", 9).alias("p_bonf"))


_SRC = f"WITH u AS (SELECT o_orderkey, CAST({_P} AS DOUBLE) AS x FROM orders), s AS (SELECT o_orderkey, x * x * x AS p FROM u)"

QUERIES = {"bh_adjust": bh_adjust, "bh_threshold": bh_threshold, "bonferroni": bonferroni}
ORACLES = {
    "bh_adjust": _SRC + """, r AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k, count(*) OVER () AS m FROM s)
      SELECT o_orderkey, round(p, 9) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 9) AS p_adj FROM r""",
    "bh_threshold": _SRC + """, r AS (SELECT p, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k, count(*) OVER () AS m FROM s)
      SELECT round(coalesce(max(p), 0.0), 9) AS threshold FROM r WHERE p <= 0.8 * k / m""",
    "bonferroni": _SRC + " SELECT o_orderkey, round(least(1.0, p * count(*) OVER ()), 9) AS p_bonf FROM s",
}
