"""Interval algebra on half-open [start, end) rows of a group column.

Overlap joins are equi-joins on fixed-width bins; a pair is reported only in
the bin where the later of both starts lies, so no distinct is needed. Empty intervals meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators import ranges


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlap_join(a: DataFrame, b: DataFrame, by: str, width: int, start: str = "start", end: str = "end", suffix: str = "_b") -> DataFrame:
    """Pairs with a.start < b.end and b.start < a.end in one group; columns of ``b`` get ``suffix``."""
    a = a.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), width)))
    b = b.where(F.col(end) > F.col(start)).withColumnsRenamed({c: c + suffix for c in b.columns if c != by})
    s, e = start + suffix, end + suffix
    b = b.withColumn("_bin", F.explode(_bins(F.col(s), F.col(e), width)))
    first = F.floor(F.greatest(F.col(start), F.col(s)) / width)
    return a.join(b, [by, "_bin"]).where((F.col(start) < F.col(e)) & (F.col(s) < F.col(end)) & (F.col("_bin") == first)).drop("_bin")


def points_in(points: DataFrame, regions: DataFrame, by: str, pos: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Points paired with every region of their group that contains them."""
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    r = regions.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), width)))
    return p.join(r, [by, "_bin"]).where((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_bin")


def collapse(df: DataFrame, by: str, gap: int = 0, start: str = "start", end: str = "end") -> DataFrame:
    """Union of touching or overlapping intervals (up to ``gap`` apart): gaps and islands on a running maximum of ends."""
    # a union per (group, start) first: repeated intervals cost one row
    rows = ranges.dealt(df.groupBy(by, start).agg(F.max(end).alias(end)), [by, start])
    rows = ranges.running(rows, [by], [start], {"_reach": ("max", F.col(end))}, own=False)
    new = F.coalesce((F.col(start) > F.col("_reach") + gap).cast("int"), F.lit(1))
    island = ranges.running(rows.withColumn("_new", new), [by], [start], {"_island": ("sum", F.col("_new"))})
    return island.groupBy(by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def _segments(a: DataFrame, b: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Elementary segments with how many intervals of each side cover them, by one sweep over the ends of both."""
    def ends(df: DataFrame, side: str, other: str) -> DataFrame:
        df = df.where(F.col(end) > F.col(start))
        opens = df.select(by, F.col(start).alias("pos"), F.lit(1).alias(side), F.lit(0).alias(other))
        return opens.unionByName(df.select(by, F.col(end).alias("pos"), F.lit(-1).alias(side), F.lit(0).alias(other)))

    moves = ends(a, "in_a", "in_b").unionByName(ends(b, "in_b", "in_a")).groupBy(by, "pos").agg(F.sum("in_a").alias("da"), F.sum("in_b").alias("db"))
    moves = ranges.dealt(moves, [by, "pos"])
    swept = ranges.running(ranges.following(moves, [by], "pos", "_to"), [by], ["pos"], {"a": ("sum", F.col("da")), "b": ("sum", F.col("db"))})
    return swept.select(by, F.col("pos").alias(start), F.col("_to").alias(end), "a", "b").where(F.col(end).isNotNull())


def subtract(a: DataFrame, b: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Collapsed parts of ``a`` that no interval of ``b`` covers."""
    return collapse(_segments(a, b, by, start, end).where("a > 0 AND b = 0"), by, 0, start, end)


def intersect(a: DataFrame, b: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Collapsed parts that both cover."""
    return collapse(_segments(a, b, by, start, end).where("a > 0 AND b > 0"), by, 0, start, end)


def union(a: DataFrame, b: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    return collapse(a.select(by, start, end).unionByName(b.select(by, start, end)), by, 0, start, end)


def coverage(df: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Depth of every covered elementary segment."""
    return _segments(df, df.limit(0), by, start, end).where("a > 0").select(by, start, end, F.col("a").alias("depth"))


def chunk(df: DataFrame, size: int, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals cut into parts of at most ``size``."""
    at = F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(size)))
    return df.where(F.col(end) > F.col(start)).withColumn("_at", at).withColumns({end: F.least(F.col(end), F.col("_at") + size), start: F.col("_at")}).drop("_at")


def midpoints(df: DataFrame, start: str = "start", end: str = "end", out: str = "mid") -> DataFrame:
    return df.withColumn(out, F.floor((F.col(start) + F.col(end)) / 2))


def total_length(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Sum of interval sizes, overlaps counted twice."""
    return df.agg(F.coalesce(F.sum(F.col(end) - F.col(start)), F.lit(0)).alias("total_length"))


def coordinate_windows(df: DataFrame, by: str, size: int, step: int, start: str = "start", end: str = "end") -> DataFrame:
    """Sliding windows of ``size`` every ``step`` over each group's [start, end); the last is clamped."""
    at = F.explode(F.sequence(F.col(start), F.greatest(F.col(start), F.col(end) - 1), F.lit(step)))
    return df.where(F.col(end) > F.col(start)).withColumn("win_start", at).withColumn("win_end", F.least(F.col("win_start") + size, F.col(end))).drop(start, end)


def row_windows(df: DataFrame, by: str, order: str, size: int, step: int) -> DataFrame:
    """Each row in every window of ``size`` consecutive rows that starts at a multiple of ``step``: (.., win). Windows that would run past the end are short."""
    first = F.greatest(F.lit(0), F.ceil((F.col("_n") - size + 1) / step))
    wins = F.when(F.floor(F.col("_n") / step) >= first, F.sequence(first, F.floor(F.col("_n") / step)))
    rows = ranges.running(ranges.dealt(df, [by, order]), [by], [order], {"_n": ("sum", F.lit(1))}).withColumn("_n", F.col("_n") - 1)
    return rows.withColumn("win", F.explode(wins)).drop("_n", ranges.RANGE)
