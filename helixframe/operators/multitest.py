"""Multiple-testing correction over a whole column of p-values.

A global rank is the only thing Benjamini-Hochberg needs from the full data.
Ranks come from counts of *distinct p-values* per range of their order, so no
task ever holds more than one range, however p-values crowd near 0, and equal ones cost one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.operators import ranges


def _ranked(df: DataFrame, p: str) -> DataFrame:
    """Distinct p (``_p``) with the count of p at or below it (``_rank``) and of all (``_m``), dealt out by ranges."""
    by_p = df.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    rows = ranges.running(ranges.dealt(by_p, ["_p"]), [], ["_p"], {"_rank": ("sum", F.col("_n"))})
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("_n").alias("_m"))))  # one row


def bh_threshold(df: DataFrame, p: str, q: float) -> DataFrame:
    """Largest p with p <= q * rank / m as one row ``threshold`` (0.0 when none passes); null and NaN p are ignored."""
    passed = _ranked(df, p).where(F.col("_p") <= F.lit(q) * F.col("_rank") / F.col("_m"))
    return passed.agg(F.coalesce(F.max("_p"), F.lit(0.0)).alias("threshold"))


def bh_adjust(df: DataFrame, p: str, out: str = "p_adj") -> DataFrame:
    """Add the step-up adjusted p: min over larger p of m * p / rank, at most 1. Null and NaN p give null."""
    ranked = _ranked(df, p).withColumn("_raw", F.least(F.lit(1.0), F.col("_p") * F.col("_m") / F.col("_rank")))
    adjusted = ranges.running(ranked, [], ["_p"], {out: ("min", F.col("_raw"))}, backwards=True).select("_p", out)
    return df.join(adjusted, df[p] == adjusted["_p"], "left").drop("_p")


def bonferroni(df: DataFrame, p: str, out: str = "p_bonf") -> DataFrame:
    """Add min(1, p * m) with m the number of non-null, non-NaN p-values."""
    m = df.agg(F.count(F.when(~F.isnan(p), F.col(p))).alias("_m"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_m")
