"""Keyed joins and merges: last-wins joins, full outer merges, zip-by-key, as-of and nearby lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators import ranges


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, by one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the least ``order`` of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def inner_join_last_wins(build: DataFrame, probe: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join where repeated build keys keep the row last in ``order``; probe rows all stay."""
    return probe.join(last_per_key(build, [key], order).drop(order), key)


def zip_by_key(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Pair every left row with the one right row of its key (the last in ``order``)."""
    return left.join(last_per_key(right, [key], order).drop(order), key)


def merge_full_outer(parts: Sequence[DataFrame], key: str, value: str, combine: str = "sum") -> DataFrame:
    """N-way outer merge of (key, value) inputs: the first value of each input per key, combined by an aggregate. One shuffle for any number of inputs."""
    stacked = None
    for i, part in enumerate(parts):
        one = part.groupBy(key).agg(F.min(value).alias(value)).withColumn("_part", F.lit(i))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy(key).agg(getattr(F, combine)(value).alias(value), F.count("*").alias("n_inputs"))


def merge_all_inputs(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys present in every input, without joins: distinct (key, input) pairs are counted."""
    stacked = None
    for i, part in enumerate(parts):
        one = part.select(key).distinct().withColumn("_part", F.lit(i))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy(key).agg(F.count("*").alias("n_inputs")).where(F.col("n_inputs") == len(parts)).select(key)


def merge_maps(a: DataFrame, b: DataFrame, key: str, value: str, combine: Callable[[Column, Column], Column], fill: float | None = None) -> DataFrame:
    """Outer merge of two keyed columns: ``combine`` where both have the key, else the one there is, or combined with ``fill``."""
    x, y = a.select(key, F.col(value).alias("_a")), b.select(key, F.col(value).alias("_b"))
    both = combine(F.col("_a"), F.col("_b"))
    if fill is not None:
        both = combine(F.coalesce("_a", F.lit(fill)), F.coalesce("_b", F.lit(fill)))
        return x.join(y, key, "full_outer").select(key, both.alias(value))
    return x.join(y, key, "full_outer").select(key, F.coalesce(both, "_a", "_b").alias(value))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, out: str) -> DataFrame:
    """Add to every left row the ``value`` of the last right row of its ``by`` group at or before ``on``.

    Both sides are unioned and swept once in ranges of their order, so nothing is paired up and no group is too long.
    """
    cols = left.columns
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    r = right.select(*by, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    swept = ranges.running(ranges.dealt(both, [*by, on]), by, [on, "_side", "_v"], {out: ("last", F.col("_v"))})
    return swept.where("_side = 1").select(*cols, out)


def insertion_interval(points: DataFrame, sorted_values: DataFrame, point: str, value: str) -> DataFrame:
    """For every point the greatest value <= it (``lo``) and the least value > it (``hi``), by one sweep over both in ranges of their order."""
    p = points.select(F.col(point).cast("double").alias("x"), F.lit(1).alias("is_point"), F.lit(None).cast("double").alias("v"))
    s = sorted_values.select(F.col(value).cast("double").alias("x"), F.lit(0).alias("is_point"), F.col(value).cast("double").alias("v")).distinct()
    both = ranges.dealt(p.unionByName(s), ["x"])
    below = ranges.running(both, [], ["x", "is_point"], {"lo": ("last", F.col("v"))})
    found = ranges.running(below, [], ["x", "is_point"], {"hi": ("last", F.col("v"))}, own=False, backwards=True)
    return found.where("is_point = 1").select(F.col("x").alias(point), "lo", "hi")


def nearby(left: DataFrame, right: DataFrame, by: Sequence[str], pos: str, width: int) -> DataFrame:
    """Pairs of rows of one ``by`` group whose positions differ by at most ``width``: an equi-join on bins, the right side in three of them."""
    rename = {c: f"{c}_r" for c in right.columns if c not in by}
    r = right.withColumnsRenamed(rename)
    r = r.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(rename[pos]) / width) + d for d in (-1, 0, 1)])))
    l = left.withColumn("_bin", F.floor(F.col(pos) / width))
    return l.join(r, [*by, "_bin"]).where(F.abs(F.col(pos) - F.col(rename[pos])) <= width).drop("_bin")


def with_fallback(left: DataFrame, right: DataFrame, key: str, value: str, fallback: Column) -> DataFrame:
    """Left join whose missing values come from ``fallback`` (say, a region parsed from the key)."""
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(value, fallback))


def translate_ids(df: DataFrame, key: str, dictionary: DataFrame, old: str, new: str) -> DataFrame:
    """Replace ids by a dictionary after dropping version suffixes; an old id with several new ones, or none, keeps itself."""
    single = dictionary.groupBy(old).agg(F.countDistinct(new).alias("_n"), F.min(new).alias("_new")).where("_n = 1").select(F.col(old).alias("_old"), "_new")
    bare = F.regexp_replace(F.col(key), r"\.\d+$", "")
    return df.join(single, bare == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


def compare_by_key(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer comparison by key: per field whether both agree (null-safe) and which side is an orphan."""
    x = a.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_in_a"))
    y = b.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_in_b"))
    j = x.join(y, key, "full_outer")
    same = [F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")).alias(f"same_{f}") for f in fields]
    side = F.when(F.col("_in_b").isNull(), "left").when(F.col("_in_a").isNull(), "right").otherwise("both").alias("side")
    return j.select(key, side, *same)
