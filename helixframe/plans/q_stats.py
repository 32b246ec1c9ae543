"""Queries: summaries, contingency tables, rank tests, meta-analysis and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import dist
from helixframe.operators import sets, stats
from helixframe.plans.q_multitest import pseudo_p
from helixframe.sources.tables import table


def _r(*cols, n=6):
    return [F.round(c, n).alias(c) for c in cols]


def summary_stats_by_segment(spark, d):
    got = stats.summary(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")
    return got.select("c_mktsegment", "n", *_r("mean", "sd", "min", "max", "p025", "p25", "p50", "p75", "p975", n=4))


def percentile_legacy(spark, d):
    c = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_acctbal")).alias("v"))
    return c.select("s_nationkey", *[F.round(stats.percentile_legacy(F.col("v"), q), 4).alias(f"p{int(q * 1000)}") for q in (0.025, 0.25, 0.5, 0.75, 0.975)])


def contingency_chisq(spark, d):
    got = stats.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return got.select("l_returnflag", "l_linestatus", "n", *_r("expected", "signed_chisq"))


def cramers_v(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.cramers_v(o, "c_mktsegment", "o_orderpriority").select("n", "df", *_r("chisq", "cramers_v"))


def phi_2x2(spark, d):
    return stats.two_by_two(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1).select("a11", "a12", "a21", "a22", F.round("phi", 6).alias("phi"))


def mann_whitney_u(spark, d):
    e = table(spark, d, "events").where("event_type IN ('click', 'view')").withColumn("g", F.col("user_id") % 5)
    got = stats.mann_whitney(e, "value", F.col("event_type") == "click", ["g"])
    return got.select("g", "n1", "n2", *_r("rank_sum", "u", "z"))


def blom_rank(spark, d):
    got = stats.blom_argument(table(spark, d, "customer"), "c_acctbal")
    return got.select("c_custkey", F.round("blom_p", 9).alias("blom_p"))


def hwe_chisq(spark, d):
    g = table(spark, d, "lineitem").withColumn("g", F.col("l_orderkey") * 31 % 3)
    g = g.groupBy("l_partkey").agg(*[F.count_if(F.col("g") == k).alias(n) for k, n in enumerate(("aa", "ab", "bb"))])
    return stats.hwe_chisq(g, "aa", "ab", "bb").select("l_partkey", F.round("hwe_chisq", 6).alias("hwe_chisq"))


def fisher_combine(spark, d):
    p = pseudo_p(spark, d).where("p > 0").join(table(spark, d, "orders"), "o_orderkey")
    return stats.fisher_combine(p, ["o_custkey"], "p").select("o_custkey", "df", F.round("fisher_chisq", 6).alias("fisher_chisq"))


def _effects(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 10).alias("marker"))
    got = li.agg(F.avg("l_discount").alias("beta"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    return got.where("se > 0")


def ivw_meta(spark, d):
    return stats.ivw_meta(_effects(spark, d), ["marker"], "beta", "se").select("marker", "n_studies", *_r("beta", "se", "z"))


def weighted_z(spark, d):
    e = _effects(spark, d).withColumn("z", F.col("beta") / F.col("se"))
    return stats.weighted_z(e, ["marker"], "z", "n").select("marker", "n", F.round("z", 6).alias("z"))


def meta_flip(spark, d):
    """Fixed-effect meta-analysis after aligning effects to the lexicographically lesser allele."""
    from helixframe.operators import genotype

    e = _effects(spark, d).withColumns({"a1": F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("G"), "a2": F.when(F.col("l_suppkey") % 2 == 0, "G").otherwise("A")})
    return stats.ivw_meta(genotype.flip_to_least(e, "a1", "a2", "beta"), ["marker"], "beta", "se").select("marker", "n_studies", *_r("beta", "se", "z"))


def f_ratio(spark, d):
    return stats.f_ratio(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY").select("df1", "df2", F.round("f", 6).alias("f"))


def hypergeom_counts(spark, d):
    li = table(spark, d, "lineitem")
    query = li.where("l_quantity >= 49").select("l_partkey")
    sets_ = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("l_partkey"))
    return stats.overlap_counts(query, sets_, li.select("l_partkey"), "l_partkey", "p_brand")


def hypergeom_upper_tail(spark, d):
    c = hypergeom_counts(spark, d)
    return c.select("p_brand", F.round(dist.hypergeom_upper(F.col("total"), F.col("marked"), F.col("drawn"), F.col("overlap")), 9).alias("p"))


def gsea_running_sum(spark, d):
    p = table(spark, d, "part")
    return stats.gsea(p, ["p_size"], "p_partkey", "p_retailprice", F.col("p_partkey") % 7 == 0).select("p_size", F.round("es", 6).alias("es"))


def hist_fixed_step(spark, d):
    got = stats.histogram(table(spark, d, "lineitem"), "l_quantity", 5.0)
    return got.select("bin", F.round("bin_start", 4).alias("bin_start"), "n")


def hist_breaks(spark, d):
    return stats.histogram_breaks(table(spark, d, "customer"), "c_acctbal", [-1000, 0, 1000, 2500, 5000, 10000])


def stratified_hist(spark, d):
    got = stats.histogram(table(spark, d, "lineitem"), "l_quantity", 10.0, ["l_returnflag"], relative=True)
    return got.select("l_returnflag", "bin", "n", F.round("share", 6).alias("share"))


def box_five_numbers(spark, d):
    return stats.five_numbers(table(spark, d, "part"), ["p_size"], "p_retailprice").select("p_size", *_r("lo", "q1", "median", "q3", "hi", n=4))


def qq_points(spark, d):
    return stats.qq_points(pseudo_p(spark, d), "p").select(*_r("observed", "expected"), "n")


def qq_lambda(spark, d):
    return stats.qq_lambda(pseudo_p(spark, d), "p").select(F.round("lambda", 6).alias("lambda"))


def manhattan_coords(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("chr"), F.col("o_custkey").alias("pos"))
    return stats.manhattan(o, "chr", "pos").select("o_orderkey", "coord")


def letter_entropy(spark, d):
    return stats.entropy(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus").select("l_returnflag", F.round("entropy", 6).alias("entropy"))


def empirical_cdf(spark, d):
    return stats.ecdf(table(spark, d, "lineitem"), "l_quantity").select("l_quantity", F.round("ecdf", 9).alias("ecdf"))


def sfs(spark, d):
    return stats.site_frequency_spectrum(table(spark, d, "events"), "user_id")


def shared_at_least_k(spark, d):
    return sets.shared_at_least(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", 25)


def reverse_map(spark, d):
    return sets.reverse_map(table(spark, d, "supplier"), "s_suppkey", "s_nationkey").select("s_nationkey", F.array_join("keys", ",").alias("keys"))


def set_overlap(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 12).alias("name"), "l_partkey")
    return sets.set_overlap(li, "name", "l_partkey").select("a", "b", "size_a", "size_b", "overlap", *_r("share_a", "share_b"))


def representative_sets(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 12).alias("name"), "l_partkey")
    return sets.representative_sets(li, "name", "l_partkey", 0.85)


def reservoir_hash_sample(spark, d):
    return sets.hash_sample(table(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey")


def bernoulli_sample(spark, d):
    return sets.bernoulli(table(spark, d, "orders"), "o_orderkey", 0.1, 7).select("o_orderkey")


def fold_assignment(spark, d):
    return sets.folds(table(spark, d, "orders"), "o_orderkey", 5).select("o_orderkey", "fold")


def downsample_counts(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return sets.downsample_counts(c, "n", 1000, ["l_suppkey"]).select("l_suppkey", "n", "sampled")


def connected_components(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    e = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("m")).join(li, "l_partkey").select(F.col("l_suppkey").alias("u"), F.col("m").alias("v"))
    return sets.components(e, "u", "v")


def best_two(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg((F.count("*") / 2).alias("dose"))
    return sets.best_alleles(g, ["l_orderkey"], "l_returnflag", "dose")


QUERIES = {f.__name__: f for f in (summary_stats_by_segment, percentile_legacy, contingency_chisq, cramers_v, phi_2x2, mann_whitney_u, blom_rank, hwe_chisq, fisher_combine, ivw_meta, weighted_z, meta_flip, f_ratio, hypergeom_counts, hypergeom_upper_tail, gsea_running_sum, hist_fixed_step, hist_breaks, stratified_hist, box_five_numbers, qq_points, qq_lambda, manhattan_coords, letter_entropy, empirical_cdf, sfs, shared_at_least_k, reverse_map, set_overlap, representative_sets, reservoir_hash_sample, bernoulli_sample, fold_assignment, downsample_counts, connected_components, best_two)}


_P = "SELECT o_orderkey, o_custkey, x * x * x AS p FROM (SELECT o_orderkey, o_custkey, CAST((o_orderkey * 48271 % 2147483647) / 2147483647.0 AS DOUBLE) AS x FROM orders)"
_EFF = "SELECT l_suppkey, l_partkey % 10 AS marker, avg(l_discount) AS beta, stddev_samp(l_discount) / sqrt(count(*)) AS se, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING stddev_samp(l_discount) > 0"
_PAIRS = "WITH r AS (SELECT DISTINCT l_suppkey % 12 AS name, l_partkey FROM lineitem), z AS (SELECT name, count(*) AS size FROM r GROUP BY 1), p AS (SELECT a.name AS a, b.name AS b, count(*) AS overlap FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.name < b.name GROUP BY 1, 2), q AS (SELECT p.*, za.size AS size_a, zb.size AS size_b FROM p JOIN z za ON za.name = a JOIN z zb ON zb.name = b)"
_U = "((o_orderkey * 1103515245 + {s}) % 2147483648) / 2147483648.0"
_LEG = "CASE WHEN {q} * (n + 1) < 1 THEN v[1] WHEN {q} * (n + 1) >= n THEN v[n] ELSE v[CAST(floor({q} * (n + 1)) AS INT)] + ({q} * (n + 1) - floor({q} * (n + 1))) * (v[CAST(floor({q} * (n + 1)) AS INT) + 1] - v[CAST(floor({q} * (n + 1)) AS INT)]) END"
ORACLES = {
    "summary_stats_by_segment": "SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(min(c_acctbal), 4) AS min, round(max(c_acctbal), 4) AS max, round(quantile_cont(c_acctbal, 0.025), 4) AS p025, round(quantile_cont(c_acctbal, 0.25), 4) AS p25, round(quantile_cont(c_acctbal, 0.5), 4) AS p50, round(quantile_cont(c_acctbal, 0.75), 4) AS p75, round(quantile_cont(c_acctbal, 0.975), 4) AS p975 FROM customer GROUP BY 1",
    "percentile_legacy": "WITH s AS (SELECT s_nationkey, list_sort(list(s_acctbal)) AS v, count(*) AS n FROM supplier GROUP BY 1) SELECT s_nationkey, " + ", ".join(f"round({_LEG.format(q=q)}, 4) AS p{int(q * 1000)}" for q in (0.025, 0.25, 0.5, 0.75, 0.975)) + " FROM s",
    "contingency_chisq": "WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT a.l_returnflag, b.l_linestatus, coalesce(c.n, 0) AS n, (SELECT sum(n) FROM c x WHERE x.l_returnflag = a.l_returnflag) * (SELECT sum(n) FROM c x WHERE x.l_linestatus = b.l_linestatus) / (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS e FROM (SELECT DISTINCT l_returnflag FROM c) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM c) b LEFT JOIN c ON c.l_returnflag = a.l_returnflag AND c.l_linestatus = b.l_linestatus) SELECT l_returnflag, l_linestatus, n, round(e, 6) AS expected, round(sign(n - e) * (n - e) * (n - e) / e, 6) AS signed_chisq FROM g",
    "cramers_v": "WITH c AS (SELECT c_mktsegment AS r, o_orderpriority AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), g AS (SELECT n, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY k) / CAST(sum(n) OVER () AS DOUBLE) AS e, r, k FROM c) SELECT CAST(sum(n) AS BIGINT) AS n, (count(DISTINCT r) - 1) * (count(DISTINCT k) - 1) AS df, round(sum((n - e) * (n - e) / e), 6) AS chisq, round(sqrt(sum((n - e) * (n - e) / e) / (sum(n) * least(count(DISTINCT r) - 1, count(DISTINCT k) - 1))), 6) AS cramers_v FROM g",
    "phi_2x2": "WITH t AS (SELECT count_if(quality = 1 AND toxic = 1) AS a11, count_if(quality <> 1 AND toxic = 1) AS a12, count_if(quality = 1 AND toxic <> 1) AS a21, count_if(quality <> 1 AND toxic <> 1) AS a22 FROM labels) SELECT CAST(a11 AS BIGINT) AS a11, CAST(a12 AS BIGINT) AS a12, CAST(a21 AS BIGINT) AS a21, CAST(a22 AS BIGINT) AS a22, round((CAST(a11 AS DOUBLE) * a22 - CAST(a12 AS DOUBLE) * a21) / sqrt(CAST(a11 + a12 AS DOUBLE) * (a21 + a22) * (a11 + a21) * (a12 + a22)), 6) AS phi FROM t",
    "mann_whitney_u": "WITH e AS (SELECT user_id % 5 AS g, event_type = 'click' AS l, rank() OVER (PARTITION BY user_id % 5 ORDER BY value) + (count(*) OVER (PARTITION BY user_id % 5, value) - 1) / 2.0 AS r FROM events WHERE event_type IN ('click', 'view')), s AS (SELECT g, sum(r) FILTER (l) AS rank_sum, count(*) FILTER (l) AS n1, count(*) FILTER (NOT l) AS n2 FROM e GROUP BY g), u AS (SELECT *, rank_sum - n1 * (n1 + 1) / 2.0 AS u FROM s) SELECT g, n1, n2, round(CAST(rank_sum AS DOUBLE), 6) AS rank_sum, round(CAST(u AS DOUBLE), 6) AS u, round((u - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM u",
    "blom_rank": "SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 - 0.375) / (count(*) OVER () + 0.25), 9) AS blom_p FROM customer",
    "hwe_chisq": "WITH g AS (SELECT l_partkey, count_if(l_orderkey * 31 % 3 = 0) AS a, count_if(l_orderkey * 31 % 3 = 1) AS b, count_if(l_orderkey * 31 % 3 = 2) AS c FROM lineitem GROUP BY 1), p AS (SELECT *, CAST(a + b + c AS DOUBLE) AS n, (2 * a + b) / (2.0 * (a + b + c)) AS p FROM g) SELECT l_partkey, round(CASE WHEN p = 0 OR p = 1 THEN 0.0 ELSE pow(a - n * p * p, 2) / (n * p * p) + pow(b - 2 * n * p * (1 - p), 2) / (2 * n * p * (1 - p)) + pow(c - n * (1 - p) * (1 - p), 2) / (n * (1 - p) * (1 - p)) END, 6) AS hwe_chisq FROM p",
    "fisher_combine": f"SELECT o_custkey, 2 * count(*) AS df, round(-2 * sum(ln(p)), 6) AS fisher_chisq FROM ({_P}) WHERE p > 0 GROUP BY 1",
    "ivw_meta": f"SELECT marker, count(*) AS n_studies, round(sum(beta / (se * se)) / sum(1 / (se * se)), 6) AS beta, round(sqrt(1 / sum(1 / (se * se))), 6) AS se, round(sum(beta / (se * se)) / sqrt(sum(1 / (se * se))), 6) AS z FROM ({_EFF}) GROUP BY 1",
    "weighted_z": f"SELECT marker, CAST(sum(n) AS BIGINT) AS n, round(sum(beta / se * sqrt(n)) / sqrt(sum(n)), 6) AS z FROM ({_EFF}) GROUP BY 1",
    "meta_flip": f"SELECT marker, count(*) AS n_studies, round(sum(b / (se * se)) / sum(1 / (se * se)), 6) AS beta, round(sqrt(1 / sum(1 / (se * se))), 6) AS se, round(sum(b / (se * se)) / sqrt(sum(1 / (se * se))), 6) AS z FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN beta ELSE -beta END AS b FROM ({_EFF})) GROUP BY 1",
    "f_ratio": "WITH g AS (SELECT var_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS v1, count(*) FILTER (c_mktsegment = 'BUILDING') AS n1, var_samp(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS v2, count(*) FILTER (c_mktsegment = 'MACHINERY') AS n2 FROM customer) SELECT n1 - 1 AS df1, n2 - 1 AS df2, round(greatest(v1, v2) / least(v1, v2), 6) AS f FROM g",
    "hypergeom_counts": "WITH bg AS (SELECT DISTINCT l_partkey FROM lineitem), q AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49) SELECT p_brand, count(*) AS marked, count(q.l_partkey) AS overlap, (SELECT count(*) FROM bg) AS total, (SELECT count(*) FROM q) AS drawn FROM part JOIN bg ON p_partkey = bg.l_partkey LEFT JOIN q ON q.l_partkey = p_partkey GROUP BY 1",
    "hypergeom_upper_tail": """WITH bg AS (SELECT DISTINCT l_partkey FROM lineitem), q AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49), c AS (SELECT p_brand, count(*) AS m, count(q.l_partkey) AS k, (SELECT count(*) FROM bg) AS t, (SELECT count(*) FROM q) AS d FROM part JOIN bg ON p_partkey = bg.l_partkey LEFT JOIN q ON q.l_partkey = p_partkey GROUP BY 1),
      x AS (SELECT *, unnest(range(k, least(m, d) + 1)) AS i FROM c) SELECT p_brand, round(least(1.0, sum(CASE WHEN d - i > t - m THEN 0 ELSE exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(t - m + 1) - lgamma(d - i + 1) - lgamma(t - m - d + i + 1) - lgamma(t + 1) + lgamma(d + 1) + lgamma(t - d + 1)) END)), 9) AS p FROM x GROUP BY 1""",
    "gsea_running_sum": "WITH r AS (SELECT p_size, p_partkey, p_retailprice, CASE WHEN p_partkey % 7 = 0 THEN abs(p_retailprice) ELSE 0 END AS h, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE 1.0 END AS m FROM part), s AS (SELECT p_size, sum(h) OVER w / sum(h) OVER (PARTITION BY p_size) - sum(m) OVER w / sum(m) OVER (PARTITION BY p_size) AS s FROM r WINDOW w AS (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING)) SELECT p_size, round(CASE WHEN max(s) >= -min(s) THEN max(s) ELSE min(s) END, 6) AS es FROM s GROUP BY 1",
    "hist_fixed_step": "WITH m AS (SELECT min(l_quantity) AS lo FROM lineitem) SELECT CAST(floor((l_quantity - lo) / 5.0) AS BIGINT) AS bin, round(lo + floor((l_quantity - lo) / 5.0) * 5.0, 4) AS bin_start, count(*) AS n FROM lineitem, m GROUP BY ALL",
    "hist_breaks": "WITH b AS (SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 1000 THEN 1 WHEN c_acctbal < 2500 THEN 2 WHEN c_acctbal < 5000 THEN 3 ELSE 4 END AS bin FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000) SELECT CAST(i AS INTEGER) AS bin, count(bin) AS n FROM range(5) t(i) LEFT JOIN b ON bin = i GROUP BY 1",
    "stratified_hist": "WITH h AS (SELECT l_returnflag, CAST(floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / 10.0) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, bin, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM h",
    "box_five_numbers": "SELECT p_size, round(min(p_retailprice), 4) AS lo, round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(quantile_cont(p_retailprice, 0.75), 4) AS q3, round(max(p_retailprice), 4) AS hi FROM part GROUP BY 1",
    "qq_points": f"WITH r AS (SELECT p, rank() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM ({_P}) WHERE p > 0) SELECT round(-log10(p), 6) AS observed, round(-log10((k + (count(*) - 1) / 2.0) / (m + 1)), 6) AS expected, count(*) AS n FROM r GROUP BY p, k, m",
    "qq_lambda": f"SELECT round(0.5 / quantile_cont(p, 0.5), 6) AS lambda FROM ({_P})",
    "manhattan_coords": "WITH e AS (SELECT o_orderpriority, max(o_custkey) AS m FROM orders GROUP BY 1), f AS (SELECT o_orderpriority, CAST(coalesce(sum(m) OVER (ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f FROM e) SELECT o_orderkey, o_custkey + f AS coord FROM orders JOIN f USING (o_orderpriority)",
    "letter_entropy": "WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT l_returnflag, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM n) SELECT l_returnflag, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1",
    "empirical_cdf": "SELECT DISTINCT l_quantity, round(count(*) OVER (ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) / CAST(count(*) OVER () AS DOUBLE), 9) AS ecdf FROM lineitem",
    "sfs": "SELECT times, count(*) AS n_units FROM (SELECT count(*) AS times FROM events GROUP BY user_id) GROUP BY 1",
    "shared_at_least_k": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 25",
    "reverse_map": "SELECT s_nationkey, array_to_string(list_sort(list(DISTINCT s_suppkey)), ',') AS keys FROM supplier GROUP BY 1",
    "set_overlap": _PAIRS + " SELECT a, b, size_a, size_b, overlap, round(overlap / size_a, 6) AS share_a, round(overlap / size_b, 6) AS share_b FROM q",
    "representative_sets": _PAIRS + " SELECT name FROM z WHERE name NOT IN (SELECT CASE WHEN size_a < size_b THEN a ELSE b END FROM q WHERE overlap > 0.85 * least(size_a, size_b))",
    "reservoir_hash_sample": f"SELECT o_orderkey FROM orders ORDER BY {_U.format(s=12345)}, o_orderkey LIMIT 100",
    "bernoulli_sample": f"SELECT o_orderkey FROM orders WHERE {_U.format(s=12352)} < 0.1",
    "fold_assignment": f"SELECT o_orderkey, CAST(floor({_U.format(s=12345)} * 5) AS INTEGER) AS fold FROM orders",
    "downsample_counts": "WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT *, n * 1000 / CAST(sum(n) OVER () AS DOUBLE) AS x FROM c), b AS (SELECT *, CAST(floor(x) AS BIGINT) AS base, row_number() OVER (ORDER BY x - floor(x) DESC, l_suppkey) AS k FROM s) SELECT l_suppkey, n, base + CASE WHEN k <= 1000 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS sampled FROM b",
    "connected_components": """WITH RECURSIVE li AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), e0 AS (SELECT DISTINCT l_suppkey AS u, min(l_suppkey) OVER (PARTITION BY l_partkey) AS v FROM li), e1 AS (SELECT * FROM e0 WHERE u <> v), e AS (SELECT u, v FROM e1 UNION SELECT v, u FROM e1),
      r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u AS node, least(u, min(v)) AS root FROM r GROUP BY u""",
    "best_two": "WITH g AS (SELECT l_orderkey, l_returnflag, count(*) / 2 AS dose FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY dose DESC, l_returnflag) AS k FROM g) SELECT l_orderkey, max(l_returnflag) FILTER (k = 1) AS first, CASE WHEN max(dose) FILTER (k = 1) >= 1.33 THEN max(l_returnflag) FILTER (k = 1) ELSE max(l_returnflag) FILTER (k = 2) END AS second FROM r GROUP BY 1",
}
