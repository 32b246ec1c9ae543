"""Row and column work on tables: filters, imputation, dummy codes, header maps, column binds, reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators import pairs, ranges


def include_exclude(df: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key is included (no list: all) and not excluded; exclusion wins."""
    if include is not None:
        df = df.join(include.select(key).distinct(), key, "left_semi")
    return df.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else df


def matching(df: DataFrame, key: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Rows whose key matches a pattern or is one of the names."""
    return df.where(F.col(key).rlike(pattern) | F.col(key).isin(list(names)))


def drop_unsound(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null, NaN or infinity in the columns."""
    keep = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        keep = keep & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return df.where(keep)


def dummy_code(df: DataFrame, column: str, order: str) -> DataFrame:
    """1.0/0.0 columns ``column_level`` for every level but the one met first in ``order``; levels are few by nature and are read once."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_o")).orderBy("_o", column).limit(1001).collect()
    if len(first) > 1000:
        raise ValueError(f"{column} has more than 1000 levels")
    return df.select("*", *[(F.col(column) == r[0]).cast("double").alias(f"{column}_{r[0]}") for r in first[1:]])


def two_levels(df: DataFrame, column: str) -> DataFrame:
    """A column of exactly two values as a boolean (the greater is true); other columns stay as they are."""
    levels = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(3).collect()]
    return df.withColumn(column, F.col(column) == max(levels)) if len(levels) == 2 else df


def plink_coding(flag: Column) -> Column:
    """2 for true, 1 for false, null stays."""
    return F.when(flag, 2).when(~flag, 1)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed by a map; others keep their names."""
    return df.withColumnsRenamed(dict(names))


def equal_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop every column that equals an earlier one in all rows: column fingerprints are one aggregation."""
    marks = df.agg(*[F.sum(F.xxhash64(F.col(c), F.xxhash64(*[F.col(k) for k in df.columns if k not in columns] or [F.lit(0)])).cast("decimal(38,0)")).alias(c) for c in columns]).first()
    seen: set = set()
    drop = [c for c in columns if marks[c] in seen or seen.add(marks[c])]
    return df.drop(*drop)


def bind_columns(parts: Sequence[DataFrame], key: str, how: str = "full_outer") -> DataFrame:
    """Tables side by side by row id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, how)
    return out


def long_to_wide(df: DataFrame, key: str, name: str, value: str, names: Sequence) -> DataFrame:
    """One column for each of the given names (stated, so no pass over the data finds them)."""
    return df.groupBy(key).pivot(name, list(names)).agg(F.first(value))


def has_variance(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Whether a group's non-NaN values differ."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return df.groupBy(*by).agg(F.coalesce(F.min(v) != F.max(v), F.lit(False)).alias("has_variance"))


def common_elements(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys that all inputs share."""
    out = parts[0].select(key)
    for p in parts[1:]:
        out = out.intersect(p.select(key))
    return out.distinct()


def ordered_pairs(df: DataFrame, name: str, block: Column, blocks: int) -> DataFrame:
    """All pairs a < b of a stated set of rows, dealt out by blocks of names so that each pair of blocks is one bounded piece of work."""
    b = df.withColumn("_b", block)
    left = b.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col(name).alias("a"), F.col("_b").alias("_i"), F.col("_o").alias("_j"))
    right = b.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col(name).alias("b"), F.col("_o").alias("_i"), F.col("_b").alias("_j"))
    return left.join(right, ["_i", "_j"]).where("a < b").select("a", "b")


def chunk_by_arm(df: DataFrame, by: str, pos: str, centromere: Column, size: int, overlap: int) -> DataFrame:
    """Loci of each arm in chunks of ``size`` by order, each with the ``overlap`` loci before it; a last chunk of less than half the size joins the one before."""
    arm = F.when(F.col(pos) < centromere, "p").otherwise("q")
    d = ranges.running(ranges.dealt(df.withColumn("arm", arm), [by, "arm", pos]), [by, "arm"], [pos], {"_n": ("sum", F.lit(1))}).withColumn("_n", F.col("_n") - 1)
    total = df.groupBy(F.col(by).alias("_by"), arm.alias("_arm")).agg(F.count("*").alias("_m"))
    d = d.join(total, F.col(by).eqNullSafe(F.col("_by")) & F.col("arm").eqNullSafe(F.col("_arm"))).drop("_by", "_arm", ranges.RANGE)
    last = F.greatest(F.lit(0), F.floor(F.col("_m") / size) - F.when((F.col("_m") % size < size / 2) | (F.col("_m") % size == 0), 1).otherwise(0))
    own = F.least(F.floor(F.col("_n") / size), last)
    also = F.when((own < last) & ((own + 1) * size - F.col("_n") <= overlap), own + 1)
    return d.withColumn("chunk", F.explode(F.filter(F.array(own, also), lambda c: c.isNotNull()))).drop("_n", "_m")


def phase_blocks(df: DataFrame, by: Sequence[str], order: str, phased: Column) -> DataFrame:
    """Block ids that grow by 2 at every unphased row, from 0, per individual."""
    rows = ranges.running(ranges.dealt(df.withColumn("_cut", (~phased).cast("long")), [*by, order]), by, [order], {"block": ("sum", F.col("_cut"))})
    return rows.withColumn("block", 2 * F.col("block")).drop("_cut", ranges.RANGE)


def covariance(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(.., x, y, covariance) for x <= y in the order of ``columns``."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = df.groupBy(*by).agg(*[F.covar_samp(columns[i], columns[j]).alias(f"_c{n}") for n, (i, j) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.col(f"_c{n}").alias("covariance")) for n, (i, j) in enumerate(pairs)])
    return got.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def mahalanobis2(df: DataFrame, x: str, y: str) -> DataFrame:
    """Squared Mahalanobis distance of every row from the mean of two columns."""
    s = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.covar_samp(x, y).alias("_c"))
    a, b = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    d2 = (a * a * F.col("_vy") - 2 * a * b * F.col("_c") + b * b * F.col("_vx")) / (F.col("_vx") * F.col("_vy") - F.col("_c") * F.col("_c"))
    return df.crossJoin(F.broadcast(s)).withColumn("d2", d2).drop("_mx", "_my", "_vx", "_vy", "_c")


def in_ellipsoid(df: DataFrame, x: str, y: str, level: float, out: str = "inside") -> DataFrame:
    """Whether each row lies in the confidence ellipse of two columns at a level: squared distance at most -2 ln(1 - level), the quantile of two degrees."""
    return mahalanobis2(df, x, y).withColumn(out, F.col("d2") <= F.lit(-2.0) * F.log(F.lit(1 - level)))


def against(queries: DataFrame, rows: DataFrame, key: str, value: str, blocks: int | None = None) -> DataFrame:
    """(a, x, b, y): every row of a stated query set with every other row, by key and value. Queries go once to each of ``blocks`` blocks of rows, twice the shuffle partitions unless given."""
    blocks = blocks or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = queries.select(F.col(key).alias("a"), F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    r = rows.select(F.col(key).alias("b"), F.col(value).alias("y"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"))
    return q.join(r, "_b").where("a <> b").drop("_b")


def cosine_pairs(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Inner product and cosine of a stated query set of vectors with all others."""
    got = pairs.tiled(queries, rows, key, vector, pairs.inners, "inner double, cosine double, sound int", F.size("v"))
    return got.select("a", "b", *[F.when(F.col("sound") == 1, F.col(c)).alias(c) for c in ("inner", "cosine")])


def regulated(df: DataFrame, p: str, fold: str, most_p: float, least_fold: float) -> DataFrame:
    """Rows with p at most ``most_p`` and log2 fold change beyond plus or minus ``least_fold``, marked up or down."""
    side = F.when(F.col(fold) > least_fold, "up").when(F.col(fold) < -least_fold, "down")
    return df.where(F.col(p) <= most_p).withColumn("side", side).where("side IS NOT NULL")


def burden(df: DataFrame, individual: str, marker: str, dosage: str) -> DataFrame:
    """Sum over markers of each individual's dosage of the minor allele.

    A marker is turned round where its dosages sum to more than their number. Sums are of decimals, which no order of rows
    rounds otherwise, so alleles of equal share stay as they are; doubles decide where a dosage is no decimal (NaN, infinite).
    """
    exact = F.col(dosage).try_cast("decimal(28,18)")
    above = F.when(F.count(exact) == F.count(dosage), F.sum(exact) > F.count(dosage)).otherwise(F.sum(dosage) > F.count(dosage))
    flip = df.groupBy(marker).agg(above.alias("_flip"))
    d = F.when(F.col("_flip"), 2 - F.col(dosage)).otherwise(F.col(dosage))
    return df.join(flip, marker).groupBy(individual).agg(F.sum(d).alias("burden"))


def variant_density(df: DataFrame, by: str, pos: str, size: int) -> DataFrame:
    """Variants per window of ``size``."""
    return df.groupBy(by, (F.floor(F.col(pos) / size) * size).alias("win_start")).agg(F.count("*").alias("n"))
