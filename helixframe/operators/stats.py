"""Summaries, contingency, rank tests and meta-analysis as aggregates; tails come from helixframe.functions.dist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixframe.operators import ranges
from helixframe.session import stored


def percentile_legacy(values: Column, q: float) -> Column:
    """Percentile at position q (n + 1) of a sorted array, linear between neighbours, clamped to the ends."""
    n = F.size(values)
    pos = F.lit(q) * (n + 1)
    k = F.floor(pos).cast("int")
    lo = F.element_at(values, F.greatest(F.lit(1), F.least(k, n)))
    hi = F.element_at(values, F.greatest(F.lit(1), F.least(k + 1, n)))
    return F.when(n == 0, F.lit(None)).when(pos < 1, F.element_at(values, 1)).when(pos >= n, F.element_at(values, -1)).otherwise(lo + (pos - k) * (hi - lo))


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample sd, min, max and the five percentiles (R-7) per group, NaN and null left out."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    shares = {"p025": 0.025, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p975": 0.975}
    moments = v.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    return _beside(moments, ranges.percentiles(v, by, value, shares), by)


def _beside(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two results of the same groups side by side; null keys meet."""
    keyed = b.withColumnsRenamed({k: f"_k_{k}" for k in by})
    return a.join(keyed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]).drop(*[f"_k_{k}" for k in by]) if by else a.crossJoin(b)


def _count_ranked(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Distinct values of each group with count ``n`` and mid-rank: ties cost one row."""
    return ranges.counted(df, by, value).withColumn("midrank", F.col("upto") - (F.col("n") - 1) / 2.0).drop("upto", "total")


def mann_whitney(df: DataFrame, value: str, is_left: Column, by: Sequence[str] = ()) -> DataFrame:
    """U of the left sample, n1, n2 and z (mid-ranks, no tie correction, no continuity correction) per group; z is null unless both sides have rows and n1 + n2 > 2."""
    sides = df.where(F.col(value).isNotNull()).withColumn("_left", is_left.cast("long"))
    by = list(by) or ["_all"]
    if by == ["_all"]:
        sides = sides.withColumn("_all", F.lit(1))
    ranked = ranges.counted(sides, by, value, {"l": F.sum("_left")}).withColumn("mid", F.col("upto") - (F.col("n") - 1) / 2.0)
    u = ranked.groupBy(*by).agg(F.sum(F.col("l") * F.col("mid")).alias("rank_sum"), F.sum("l").alias("n1"), F.sum(F.col("n") - F.col("l")).alias("n2"))
    u = u.withColumn("u", F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    sigma = F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12.0)
    z = F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n1") + F.col("n2") > 2), (F.col("u") - F.col("n1") * F.col("n2") / 2.0) / sigma)
    return u.withColumn("z", z).drop("_all")


def blom_argument(df: DataFrame, value: str, c: float = 3 / 8, out: str = "blom_p") -> DataFrame:
    """Add (midrank - c) / (n - 2c + 1), whose normal quantile is the Blom score; null and NaN stay null."""
    sound = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranked = _rank_everything(sound, value)
    n = F.col("_total")
    ranked = ranked.select(F.col(value).alias("_v"), ((F.col("midrank") - c) / (n - 2 * c + 1)).alias(out))
    return df.join(ranked, df[value] == ranked["_v"], "left").drop("_v")


def _rank_everything(df: DataFrame, value: str) -> DataFrame:
    """Mid-ranks over a whole column without a single-task sort: value, n, midrank, _total."""
    ranked = ranges.counted(df, [], value)
    return ranked.select(value, "n", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("midrank"), F.col("total").alias("_total"))


def contingency(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Cells of a table with count, expected count and signed chi-square term, absent cells included."""
    cells = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull()).groupBy(rows, cols).agg(F.count("*").alias("n"))
    r, c, t = cells.groupBy(rows).agg(F.sum("n").alias("_r")), cells.groupBy(cols).agg(F.sum("n").alias("_c")), cells.agg(F.sum("n").alias("_t"))
    grid = r.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(t)).join(cells, [rows, cols], "left")  # a row for each cell of the table, by its margins
    n, e = F.coalesce("n", F.lit(0)), F.col("_r") * F.col("_c") / F.col("_t")
    return grid.select(rows, cols, n.alias("n"), e.alias("expected"), (F.signum(n - e) * (n - e) * (n - e) / e).alias("signed_chisq"))


def cramers_v(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """One row: chi-square, n, degrees of freedom and Cramer's V."""
    cells = contingency(df, rows, cols)
    got = cells.agg(F.sum(F.abs("signed_chisq")).alias("chisq"), F.sum("n").alias("n"), F.countDistinct(rows).alias("_r"), F.countDistinct(cols).alias("_c"))
    return got.select("chisq", "n", ((F.col("_r") - 1) * (F.col("_c") - 1)).alias("df"), F.sqrt(F.col("chisq") / (F.col("n") * F.least(F.col("_r") - 1, F.col("_c") - 1))).alias("cramers_v"))


def two_by_two(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """a11 (both), a12 (only y), a21 (only x), a22 (neither) and phi; rows with a null side are left out."""
    t = df.where(x.isNotNull() & y.isNotNull()).agg(F.count_if(x & y).alias("a11"), F.count_if(~x & y).alias("a12"), F.count_if(x & ~y).alias("a21"), F.count_if(~x & ~y).alias("a22"))
    d = [F.col(c).cast("double") for c in ("a11", "a12", "a21", "a22")]
    phi = (d[0] * d[3] - d[1] * d[2]) / F.sqrt((d[0] + d[1]) * (d[2] + d[3]) * (d[0] + d[2]) * (d[1] + d[3]))
    return t.withColumn("phi", phi)


def hwe_chisq(df: DataFrame, aa: str, ab: str, bb: str, out: str = "hwe_chisq") -> DataFrame:
    """Add the Hardy-Weinberg chi-square of genotype counts (1 df; 0 where an allele is absent)."""
    n = F.col(aa) + F.col(ab) + F.col(bb)
    p = (2 * F.col(aa) + F.col(ab)) / (2.0 * n)
    q = 1 - p
    want = [n * p * p, 2 * n * p * q, n * q * q]
    terms = [(F.col(c) - e) * (F.col(c) - e) / e for c, e in zip((aa, ab, bb), want)]
    return df.withColumn(out, F.when((p == 0) | (q == 0), F.lit(0.0)).otherwise(terms[0] + terms[1] + terms[2]))


def fisher_combine(df: DataFrame, by: Sequence[str], p: str) -> DataFrame:
    """-2 sum ln p (infinite from a p of 0 on) and its degrees of freedom per group; null p are ignored."""
    ln = F.when(F.col(p) > 0, F.log(p)).otherwise(F.lit(float("-inf")))
    return df.where(F.col(p).isNotNull()).groupBy(*by).agg((-2 * F.sum(ln)).alias("fisher_chisq"), (2 * F.count(p)).alias("df"))


def ivw_meta(df: DataFrame, by: Sequence[str], beta: str, se: str) -> DataFrame:
    """Inverse-variance fixed-effect mean, standard error and z per group."""
    w = 1 / (F.col(se) * F.col(se))
    got = df.where((F.col(se) > 0) & F.col(beta).isNotNull()).groupBy(*by).agg(F.sum(w * F.col(beta)).alias("_wb"), F.sum(w).alias("_w"), F.count("*").alias("n_studies"))
    return got.select(*by, "n_studies", (F.col("_wb") / F.col("_w")).alias("beta"), F.sqrt(1 / F.col("_w")).alias("se"), (F.col("_wb") / F.sqrt("_w")).alias("z"))


def weighted_z(df: DataFrame, by: Sequence[str], z: str, n: str) -> DataFrame:
    """Sample-size weighted z per group: sum(z sqrt n) / sqrt(sum n)."""
    return df.groupBy(*by).agg((F.sum(F.col(z) * F.sqrt(n)) / F.sqrt(F.sum(n))).alias("z"), F.sum(n).alias("n"))


def f_ratio(df: DataFrame, by: str, value: str, first: str, second: str) -> DataFrame:
    """Variance ratio (greater over smaller) of two groups with (n1 - 1, n2 - 1) degrees of freedom."""
    g = df.agg(*[f(F.when(F.col(by) == k, F.col(value))).alias(f"{a}{i}") for i, k in ((1, first), (2, second)) for a, f in (("v", F.var_samp), ("n", F.count))])
    return g.select((F.greatest("v1", "v2") / F.least("v1", "v2")).alias("f"), (F.col("n1") - 1).alias("df1"), (F.col("n2") - 1).alias("df2"))


def histogram(df: DataFrame, value: str, step: float, by: Sequence[str] = (), relative: bool = False) -> DataFrame:
    """Counts of bins [lo + k step, lo + (k + 1) step) from the least value of all; ``relative`` adds each bin's share of its group."""
    ends = df.agg(F.min(value).alias("_lo"))
    k = F.floor((F.col(value) - F.col("_lo")) / step)
    got = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(*by, "_lo", k.alias("bin")).agg(F.count("*").alias("n"))
    got = got.withColumn("bin_start", F.col("_lo") + F.col("bin") * step).drop("_lo")
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by))) if relative else got


def histogram_breaks(df: DataFrame, value: str, breaks: Sequence[float]) -> DataFrame:
    """Counts of [b0, b1), .., the last one closed; values outside are left out. All bins are returned."""
    b = F.array(*[F.lit(float(x)) for x in breaks])
    k = F.least(F.size(F.filter(b, lambda x: x <= F.col(value))) - 1, F.lit(len(breaks) - 2))
    n = df.where((F.col(value) >= breaks[0]) & (F.col(value) <= breaks[-1])).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(len(breaks) - 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(n), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers per group: min, quartiles, max."""
    v = df.where(F.col(value).isNotNull())
    ends = v.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    got = _beside(ends, ranges.percentiles(v, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by)
    return got.select(*by, "lo", "q1", "median", "q3", "hi")


def qq_points(df: DataFrame, p: str) -> DataFrame:
    """Observed against expected -log10 p by rank over (n + 1) of distinct p (ties share the mid-rank), with their count."""
    ranked = _rank_everything(df.where(F.col(p).isNotNull() & (F.col(p) > 0)), p)
    return ranked.select((-F.log10(p)).alias("observed"), (-F.log10(F.col("midrank") / (F.col("_total") + 1))).alias("expected"), "n")


def qq_lambda(df: DataFrame, p: str) -> DataFrame:
    """0.5 / median(p)."""
    return ranges.percentiles(df.where(F.col(p).isNotNull()), [], p, {"m": 0.5}).select((F.lit(0.5) / F.col("m")).alias("lambda"))


def manhattan(df: DataFrame, chromosome: str, pos: str) -> DataFrame:
    """Add ``coord``, the position after all earlier chromosomes laid end to end (in byte order of their names)."""
    ends = df.groupBy(chromosome).agg(F.max(pos).alias("_end"))  # a row a chromosome
    before = Window.orderBy(chromosome).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(chromosome, F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("_offset"))
    return df.join(F.broadcast(ends), chromosome).withColumn("coord", F.col(pos) + F.col("_offset")).drop("_offset")


def gsea(df: DataFrame, by: Sequence[str], order: str, weight: str, member: Column) -> DataFrame:
    """Running-sum enrichment score per group: weighted hits up, misses down; the extreme deviation; null where all or none are members."""
    hit = F.when(member, F.abs(weight)).otherwise(0.0)
    rows = df.select(*by, order, weight, hit.alias("_hit"), F.when(member, 0.0).otherwise(1.0).alias("_miss"))
    totals = rows.groupBy(*by).agg(F.sum("_hit").alias("_hits"), F.sum("_miss").alias("_misses"))
    # by falling weight: ranges of its negative
    rows = ranges.dealt(rows.withColumn("_down", -F.col(weight)), [*by, "_down", order])
    rows = _beside(ranges.running(rows, by, ["_down", order], {"_h": ("sum", F.col("_hit")), "_m": ("sum", F.col("_miss"))}), totals, by)
    run = rows.select(*by, (F.try_divide("_h", "_hits") - F.try_divide("_m", "_misses")).alias("_s"))
    got = run.groupBy(*by).agg(F.max("_s").alias("_hi"), F.min("_s").alias("_lo"))
    return got.select(*by, F.when(F.col("_hi") >= -F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("es"))


def shuffled(key: Column, replicate: Column, seed: int = 0) -> Column:
    """A number below 2^31 - 1 from two integers, the same in any engine: ranks by it are one permutation a replicate."""
    m = F.lit(2147483647)
    h = F.pmod(F.pmod(key.cast("long"), m) * 48271 + replicate.cast("long") * 69621 + seed, m)
    return F.pmod(F.pmod(h * h, m) * 16807 + h, m)


#: Scores closer than this count as equal, since sums depend on their order in the last digits.
_SAME = 1e-9


def _hit_extremes(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, es) from members alone: rows (by, position from 1, |weight|, total, hits in all): a running sum is extreme just before or at a member."""
    totals = hits.groupBy(*by).agg(F.sum("_w").alias("_hits"))
    rows = ranges.running(ranges.dealt(hits, [*by, "position"]), by, ["position"], {"_h": ("sum", F.col("_w")), "_j": ("sum", F.lit(1))})
    rows = _beside(rows, totals, by)
    miss = F.try_divide((F.col("position") - F.col("_j")).cast("double"), (F.col("total") - F.col("members")).cast("double"))
    got = rows.groupBy(*by).agg(F.max(F.try_divide("_h", "_hits") - miss).alias("_hi"), F.min(F.try_divide(F.col("_h") - F.col("_w"), F.col("_hits")) - miss).alias("_lo"))
    hi, lo = F.greatest("_hi", F.lit(0.0)), F.least("_lo", F.lit(0.0))
    return got.select(*by, F.when(hi >= -lo - _SAME, hi).otherwise(lo).alias("es"))


def gsea_permutations(df: DataFrame, by: Sequence[str], order: str, weight: str, member: Column, rounds: int, seed: int = 0) -> DataFrame:
    """Enrichment score per group with its permutation p: (by, es, permuted, beyond, p).

    In each of ``rounds`` replicates as many rows as are members are drawn among the group's, by ranks of seeded hash numbers of ``order`` (an integer); all groups
    and replicates go through one sweep. p is the share of replicates of the score's own sign (``permuted``) that lie beyond it; null without any. Groups of members alone, or none, are left out.
    """
    rows = df.select(*by, order, F.abs(weight).cast("double").alias("_w"), (-F.col(weight)).alias("_down"), F.when(member, 1).otherwise(0).alias("_m"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"), F.sum("_m").alias("members")).where((F.col("members") > 0) & (F.col("members") < F.col("total")))
    placed = ranges.running(ranges.dealt(rows, [*by, "_down", order]), by, ["_down", order], {"position": ("sum", F.lit(1))})
    match = [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(by)]
    placed = stored(placed.join(totals.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(by)], "total", "members"), match).select(*by, order, "_w", "_m", "position", "total", "members"), "placed")
    drawn = placed.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_u", shuffled(F.col(order), F.col("replicate"), seed))
    keys = [*by, "replicate"]
    drawn = ranges.running(ranges.dealt(drawn, [*keys, "_u", order]), keys, ["_u", order], {"_rank": ("sum", F.lit(1))}).where(F.col("_rank") <= F.col("members"))
    cols = [*keys, "position", "_w", "total", "members"]
    hits = drawn.select(*cols).unionByName(placed.where("_m = 1").withColumn("replicate", F.lit(0)).select(*cols))
    es = stored(_hit_extremes(hits, keys), "scores")
    own = es.where("replicate = 0").select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(by)], F.col("es").alias("own"))
    met = es.where("replicate > 0").join(own, match)
    same = F.when(F.col("own") > 0, F.col("es") > 0).otherwise(F.col("es") <= 0)
    beyond = F.when(F.col("own") > 0, F.col("es") > F.col("own") + _SAME).otherwise(F.col("es") < F.col("own") - _SAME)
    got = met.groupBy(*by).agg(F.max("own").alias("es"), F.count_if(same).alias("permuted"), F.count_if(same & beyond).alias("beyond"))
    return got.withColumn("p", F.try_divide(F.col("beyond").cast("double"), F.col("permuted").cast("double")))


def overlap_counts(query: DataFrame, sets: DataFrame, background: DataFrame, item: str, name: str) -> DataFrame:
    """Hypergeometric counts per set: background total, set size within it, query size within it, overlap."""
    bg = background.select(item).distinct()
    q = query.select(item).distinct().join(bg, item, "left_semi").withColumn("_q", F.lit(1))
    s = sets.select(name, item).distinct().join(bg, item, "left_semi").join(q, item, "left")
    totals = bg.agg(F.count("*").alias("total")).crossJoin(q.agg(F.count("*").alias("drawn")))
    return s.groupBy(name).agg(F.count("*").alias("marked"), F.count("_q").alias("overlap")).crossJoin(F.broadcast(totals))


def entropy(df: DataFrame, by: Sequence[str], letter: str) -> DataFrame:
    """Shannon entropy (nats) of the letters of each group."""
    n = df.groupBy(*by, letter).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    return n.groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    r = _rank_everything(df.where(F.col(value).isNotNull()), value)
    return r.select(value, ((F.col("midrank") + (F.col("n") - 1) / 2.0) / F.col("_total")).alias("ecdf"))


def site_frequency_spectrum(df: DataFrame, unit: str, highest: int | None = None) -> DataFrame:
    """How many units occur once, twice, ..: (times, n_units)."""
    got = df.groupBy(unit).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("n_units"))
    return got.where(F.col("times") <= highest) if highest else got


def bins_default(n: int) -> int:
    """Default number of breaks: int(sqrt(2 n)) + 1."""
    return int((2 * n) ** 0.5) + 1
