"""Top-k, set membership, overlap categories, sampling, components and bag operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixframe.operators import ranges
from helixframe.session import stored


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def best_alleles(df: DataFrame, by: Sequence[str], allele: str, dosage: str, homozygous: float = 1.33) -> DataFrame:
    """The two likeliest alleles per group; from ``homozygous`` on the first counts twice."""
    two = top_k(df, by, [F.col(dosage).desc(), F.col(allele)], 2)
    got = two.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.col(allele))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col(dosage))).alias("_d"), F.max(F.when(F.col("rank") == 2, F.col(allele))).alias("_second"))
    return got.select(*by, "first", F.when(F.col("_d") >= homozygous, F.col("first")).otherwise(F.col("_second")).alias("second"))


def shared_at_least(df: DataFrame, item: str, group: str, k: int) -> DataFrame:
    """Items that occur in at least k different groups, with their number."""
    return df.select(item, group).distinct().groupBy(item).agg(F.count("*").alias("n_groups")).where(F.col("n_groups") >= k)


def reverse_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """value -> sorted set of keys."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def set_overlap(df: DataFrame, name: str, item: str) -> DataFrame:
    """Pairs of sets (a < b) that share items: sizes, overlap and the overlap's share of each. Pairs come from shared items."""
    rows = df.select(name, item).distinct()
    sizes = rows.groupBy(name).agg(F.count("*").alias("size"))
    pairs = rows.select(F.col(name).alias("a"), item).join(rows.select(F.col(name).alias("b"), item), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"))
    pairs = pairs.join(sizes.select(F.col(name).alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col(name).alias("b"), F.col("size").alias("size_b")), "b")
    return pairs.select("a", "b", "size_a", "size_b", "overlap", (F.col("overlap") / F.col("size_a")).alias("share_a"), (F.col("overlap") / F.col("size_b")).alias("share_b"))


def hash_uniform(key: Column, seed: int = 0) -> Column:
    """A pseudo-random number in [0, 1) from an integer key, the same in any engine."""
    x = (F.pmod(key.cast("long"), F.lit(2147483648)) * F.lit(1103515245) + F.lit(12345 + seed)) % F.lit(2147483648)
    return x / F.lit(2147483648.0)


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement: the least hash numbers (reservoir by order statistics), ties by key."""
    return df.withColumn("_u", hash_uniform(F.col(key), seed)).orderBy("_u", key).limit(k).drop("_u")


def bernoulli(df: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    return df.where(hash_uniform(F.col(key), seed) < rate)


def folds(df: DataFrame, key: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Split into k parts by hash numbers."""
    return df.withColumn(out, F.floor(hash_uniform(F.col(key), seed) * k).cast("int"))


def bootstrap(df: DataFrame, key: str, rounds: int, seed: int = 0) -> DataFrame:
    """Poisson bootstrap: every row ``times`` (Poisson with mean 1 by its hash number) in each of ``rounds``; rows drawn no time are left out."""
    u = hash_uniform(F.col(key) * 31 + F.col("round") * 7919, seed)
    cumulative, at, steps = 0.0, 0.36787944117144233, []
    for n in range(12):
        cumulative += at
        steps.append(cumulative)
        at /= n + 1
    times = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    return df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("times", times).where("times > 0")


def downsample_counts(df: DataFrame, count: str, total: int, order: Sequence[str]) -> DataFrame:
    """Counts scaled down to ``total`` by largest remainders, without drawing: deterministic and exact."""
    every = df.agg(F.sum(count).alias("_sum"))
    share = F.col(count) * F.lit(total) / F.col("_sum")
    rows = df.crossJoin(F.broadcast(every)).withColumns({"_base": F.floor(share), "_rest": share - F.floor(share)})
    left = rows.agg((F.lit(total) - F.sum("_base")).alias("_left"))
    cut = rows.select("_rest", *order).orderBy(F.desc("_rest"), *order)
    w = Window.orderBy(F.desc("_rest"), *order)
    ranked = cut.withColumn("_n", F.row_number().over(w)).drop("_rest")
    return rows.join(ranked, list(order)).crossJoin(F.broadcast(left)).withColumn("sampled", F.col("_base") + (F.col("_n") <= F.col("_left")).cast("long")).drop("_base", "_rest", "_n", "_left", "_sum")


def components(edges: DataFrame, u: str, v: str, max_rounds: int | None = None) -> DataFrame:
    """(node, root): least node of each connected component, by min-label hooking and pointer jumping; each round ends in a table in the shared folder. Rounds go on until nothing changes; where ``max_rounds`` are stated and do not suffice, an error says so."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    e = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(e.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")))
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        near = e.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("_m"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "_m").alias("_h"))
        jump = labels.select(F.col("node").alias("_h"), F.col("root").alias("_j"))
        new = stored(hooked.join(jump, "_h").select("node", F.col("root").alias("_old"), F.least("_h", "_j").alias("root")))
        changed = new.where("root <> _old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def verify_sorted(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose ``value`` is below its predecessor's in the given order: none where the order holds. Groups are swept by ranges."""
    before = ranges.running(ranges.dealt(df, [*by, *order]), by, order, {"_before": ("last", F.struct(F.col(value).alias("v")))}, own=False)
    return before.where(F.col(value) < F.col("_before.v")).drop("_before", ranges.RANGE)


def span_groups(df: DataFrame, by: Sequence[str], order: str, predicate: Column, out: str = "span") -> DataFrame:
    """Number the runs of equal predicate within each group, from 0. Groups are swept by ranges."""
    rows = ranges.dealt(df.withColumn("_p", predicate), [*by, order])
    rows = ranges.running(rows, by, [order], {"_before": ("last", F.struct(F.col("_p").alias("v")))}, own=False)
    change = F.coalesce((F.col("_p") != F.col("_before.v")).cast("long"), F.lit(0))
    return ranges.running(rows.withColumn("_c", change), by, [order], {out: ("sum", F.col("_c"))}).drop("_p", "_before", "_c", ranges.RANGE)


def representative_sets(df: DataFrame, name: str, item: str, most: float) -> DataFrame:
    """Sets left after dropping, of each pair that shares more than ``most`` of the smaller one, the smaller (or greater name)."""
    pairs = set_overlap(df, name, item).where(F.col("overlap") > most * F.least("size_a", "size_b"))
    drop = pairs.select(F.when((F.col("size_a") < F.col("size_b")), F.col("a")).otherwise(F.col("b")).alias(name)).distinct()
    return df.select(name).distinct().join(drop, name, "left_anti")


def multinomial(df: DataFrame, name: str, weight: str, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` independent draws by weight: (name, n), names drawn no time left out. Draws are hash numbers looked up in the cumulated weights."""
    from helixframe.operators.joins import as_of

    spark = df.sparkSession
    w = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    total = df.agg(F.sum(weight).alias("_t"))
    steps = df.where(F.col(weight) > 0).crossJoin(F.broadcast(total)).select(F.lit(1).alias("_g"), F.coalesce(F.sum(F.col(weight) / F.col("_t")).over(w), F.lit(0.0)).alias("x"), name)  # one row a category
    u = spark.range(draws).select(F.lit(1).alias("_g"), hash_uniform(F.col("id") * 40503, seed).alias("x"))
    return as_of(u, steps, ["_g"], "x", name, "_d").groupBy(F.col("_d").alias(name)).agg(F.count("*").alias("n"))


def jump(df: DataFrame, by: Sequence[str], order: str, predicate: Column) -> DataFrame:
    """Where a predicate that holds from some row on begins: (by.., last_false, first_true), null where it holds for all or none."""
    return df.groupBy(*by).agg(F.max(F.when(~predicate, F.col(order))).alias("last_false"), F.min(F.when(predicate, F.col(order))).alias("first_true"))
