"""Connected components by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Large: every u links its greater neighbours to the least of all; small: its smaller ones and itself."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of one orderable type): root is the component's least node.

    Self-links and links with a null end are ignored, repeated ones count once. The number of rounds grows with the
    logarithm of the longest path; each round ends in a written table.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.materialize(now, "edges")
    mark = _mark(now)
    while mark[0]:
        now = common.materialize(_star(_star(now, True), False), "edges")
        then, mark = mark, _mark(now)
        if then == mark:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
