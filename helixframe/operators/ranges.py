"""Running aggregates and ranks over orders of any length.

Rows are dealt out by ranges of the order, whose borders Spark places by a bounded sample, so neither a long
group nor a lopsided axis ends in one task; equal keys share a range. Each range is swept by itself, and one
row a range carries what came before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixframe.session import stored_by

RANGE = "_range"
#: What a running aggregate does inside a range, and how it takes in what came before.
_SUM: tuple[Callable, Callable] = (F.sum, lambda here, before: F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
_KINDS: dict[str, tuple[Callable, Callable]] = {"sum": _SUM, "max": (F.max, F.greatest), "min": (F.min, F.least), "last": (lambda c: F.last(c, ignorenulls=True), F.coalesce)}


def dealt(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """``df`` with its range's number in RANGE, as a stored table: the numbers stay whatever is lost, and sweeps of a range move no rows. Ranges are twice the shuffle partitions."""
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored_by(df.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id()), RANGE, n, "ranges")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], aggregates: dict[str, tuple[str, Column]], own: bool = True, backwards: bool = False) -> DataFrame:
    """Add running aggregates {name: (sum, max, min or last, column)} over each group in order to a table dealt by group and order.

    A range takes in what came before it for the group that runs on into it, one group at most: so what is carried is a row a range and is broadcast.
    ``own``: the row itself counts; ``backwards``: from the last row to the first. ``last`` is the last
    value that is not null.
    """
    turned = lambda c: F.col(c).desc() if backwards else F.col(c).asc()
    inside = Window.partitionBy(*by, RANGE).orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    earlier = Window.partitionBy(*by).orderBy(turned(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if backwards else F.max_by

    def whole(kind: str, column: Column) -> Column:
        if kind != "last":
            return _KINDS[kind][0](column)
        return pick(column, F.when(column.isNotNull(), F.struct(*order)))

    parts = df.groupBy(*by, RANGE).agg(*[whole(kind, column).alias(f"_carry_{name}") for name, (kind, column) in aggregates.items()])
    carried = parts.select(*by, RANGE, *[_KINDS[kind][0](f"_carry_{name}").over(earlier).alias(f"_carry_{name}") for name, (kind, _) in aggregates.items()])
    keys = [*by, RANGE]
    some = reduce(or_, [F.col(f"_carry_{name}").isNotNull() for name in aggregates])
    right = carried.where(some).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_carry_{name}" for name in aggregates])
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) if k != RANGE else F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    swept = df.select("*", *[_KINDS[kind][0](column).over(inside).alias(f"_here_{name}") for name, (kind, column) in aggregates.items()])
    met = swept.join(F.broadcast(right), match, "left")  # a row a range
    met = met.withColumns({name: _KINDS[kind][1](F.col(f"_here_{name}"), F.col(f"_carry_{name}")) for name, (kind, _) in aggregates.items()})
    return met.drop(*[f"_k{i}" for i in range(len(keys))], *[f"_carry_{name}" for name in aggregates], *[f"_here_{name}" for name in aggregates])


def following(df: DataFrame, by: Sequence[str], order: str, out: str) -> DataFrame:
    """Add the next row's ``order`` in each group of a dealt table, null for the last."""
    here = F.lead(order).over(Window.partitionBy(*by, RANGE).orderBy(order))
    first = df.groupBy(*by, RANGE).agg(F.min(order).alias("_first"))
    after = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*by, RANGE])], F.lead("_first").over(Window.partitionBy(*by).orderBy(RANGE)).alias("_after"))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*by, RANGE])]
    return df.withColumn("_next", here).join(F.broadcast(after.where("_after IS NOT NULL")), match, "left").withColumn(out, F.coalesce("_next", "_after")).drop("_next", "_after", *[f"_k{i}" for i in range(len(by) + 1)])


def counted(df: DataFrame, by: Sequence[str], value: str, also: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values of each group with their count ``n`` (and ``also``), ``upto`` (rows at or below) and the group's ``total``."""
    rows = df.groupBy(*by, value).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (also or {}).items()])
    rows = running(dealt(rows, [*by, value]), by, [value], {"upto": ("sum", F.col("n"))})
    totals = df.groupBy(*by).agg(F.count("*").alias("total")) if by else df.agg(F.count("*").alias("total"))
    if not by:
        return rows.crossJoin(F.broadcast(totals)).drop(RANGE)  # one row
    keyed = totals.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(by)], "total")
    return rows.join(keyed, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(by)]).drop(RANGE, *[f"_t{i}" for i in range(len(by))])


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles per group, linear between the values around (n - 1) q: the values at two ranks, whatever the number of distinct ones."""
    rows = counted(df, by, value)
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col(value)))
    asked = {}
    for name, q in shares.items():
        low = F.floor((F.col("total") - 1) * F.lit(q))
        asked[name] = (at(low + 1).alias(f"_lo_{name}"), at(F.least(low + 2, F.col("total"))).alias(f"_hi_{name}"), F.max((F.col("total") - 1) * F.lit(q) - low).alias(f"_part_{name}"))
    got = rows.groupBy(*by).agg(*[c for three in asked.values() for c in three])
    mixed = lambda n: ((1 - F.col(f"_part_{n}")) * F.col(f"_lo_{n}") + F.col(f"_part_{n}") * F.col(f"_hi_{n}")).alias(n)
    return got.select(*by, *[mixed(n) for n in shares])
