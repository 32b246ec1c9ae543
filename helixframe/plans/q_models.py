"""Queries: regressions, score tests, normalisation, trees and streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import counts, models, pruning, sets, tree
from helixframe.plans.q_genotype import _G as DOSAGES
from helixframe.plans.q_genotype import dosages
from helixframe.sources.tables import table


def _r(*cols, n=6):
    return [F.round(c, n).alias(c) for c in cols]


def ols_simple(spark, d):
    got = models.ols_simple(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return got.select("l_returnflag", "n", *_r("slope", "intercept", "slope_se", "intercept_se", n=4), F.round("r2", 6).alias("r2"))


def ols_multiple(spark, d):
    li = table(spark, d, "lineitem")
    return models.ols(li, ["l_returnflag"], "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("l_returnflag", "term", "n", F.round("beta", 4).alias("beta"))


def through_origin_3sigma(spark, d):
    return models.through_origin_3sigma(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select(F.round("slope", 6).alias("slope"), "n")


def _case(spark, d):
    return table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def logistic(spark, d):
    got = models.glm(_case(spark, d), ["l_linestatus"], "y", ["l_quantity"], "logistic")
    return got.select("l_linestatus", "term", "n", *_r("beta", "se"), F.round("z", 5).alias("z"))


def poisson(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), (F.max("l_suppkey") % 5).alias("x"))
    return models.glm(o, [], "n_lines", ["x"], "poisson").select("term", "n", *_r("beta", "se"), F.round("z", 5).alias("z"))


def score_test(spark, d):
    return models.score_test(_case(spark, d), ["l_linestatus"], "y", "l_quantity").select("l_linestatus", "n", F.round("score_chisq", 6).alias("score_chisq"))


def marker_scan(spark, d):
    """Single-marker association scan: a phenotype of the individual on each marker's dosage, all markers in one aggregation."""
    rows = dosages(spark, d).withColumn("y", (F.col("ind") * 37 % 101) / 10.0)
    return models.ols_simple(rows, ["marker"], "y", "dosage").select("marker", "n", *_r("slope", "slope_se", "r2"))


def poisson_mixture(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return models.fit_poisson_mixture(c, "n", 2).select("component", *_r("mean", "share", n=4))


def principal_components(spark, d):
    li = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return models.pca(li, "row", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)


def ld_prune(spark, d):
    """The rule that releases one outdated marker a step, over all individuals."""
    known = F.when(F.col("dosage").isNotNull(), F.struct("ind", "dosage"))
    m = dosages(spark, d).groupBy("marker").agg(F.collect_list(known).alias("m"))
    m = m.select((F.col("marker") % 2).alias("chr"), (F.col("marker") * 100).alias("pos"), "marker", F.col("m.ind").alias("inds"), F.col("m.dosage").alias("dosages"))
    return pruning.ld_prune(m, "chr", "pos", "marker", "dosages", 0.3, 1000, "inds")


def _expression(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy((F.col("l_partkey") % 50).alias("gene"), F.col("s_nationkey").alias("sample")).agg(F.count("*").alias("n"))


def size_factors(spark, d):
    return counts.size_factors(_expression(spark, d), "gene", "sample", "n").select("sample", F.round("size_factor", 6).alias("size_factor"))


def total_count_factors(spark, d):
    return counts.total_count_factors(_expression(spark, d), "sample", "n").select("sample", F.round("size_factor", 6).alias("size_factor"))


def rpkm(spark, d):
    lengths = spark.range(45).select(F.col("id").alias("gene"), (F.col("id") * 10 + 100).alias("length"))
    return counts.rpkm(_expression(spark, d), lengths, "gene", "sample", "n", "length").select("gene", "sample", F.round("rpkm", 4).alias("rpkm"))


def row_moments(spark, d):
    return counts.row_moments(_expression(spark, d), "gene", "n").select("gene", *_r("mean", "variance"))


def low_count_filter(spark, d):
    return counts.filter_low(_expression(spark, d), "gene", "sample", "n", 45, 0.5)


def read_counting(spark, d):
    e = table(spark, d, "events")
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    reads = e.where("event_id % 2 = 0").select(F.col("event_id").alias("name"), (F.col("user_id") % 10).alias("chr"), s.alias("start"), (s + 600).alias("end"), F.lit("+").alias("strand"), (F.col("event_id") % 40).cast("int").alias("mapq"), F.when(F.col("event_id") % 14 == 0, 2).otherwise(1).alias("nh"))
    features = e.where("event_id % 5 = 1").select(F.concat(F.lit("g"), F.col("event_id") % 30).alias("gene"), (F.col("user_id") % 10).alias("chr"), s.alias("start"), (s + 900).alias("end"), F.lit("+").alias("strand"))
    return counts.count_reads(reads, features, 3600)


def hierarchy_ancestors(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return tree.ancestors(n.unionByName(c), "child", "parent", 4)


def poisson_bootstrap(spark, d):
    return sets.bootstrap(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 3).select("s_suppkey", "round", "times")


QUERIES = {f.__name__: f for f in (ols_simple, ols_multiple, through_origin_3sigma, logistic, poisson, score_test, marker_scan, poisson_mixture, principal_components, ld_prune, size_factors, total_count_factors, rpkm, row_moments, low_count_filter, read_counting, hierarchy_ancestors, poisson_bootstrap)}

_REGR = "{k}, regr_count({y}, {x}) AS n, round(regr_slope({y}, {x}), {r}) AS slope"
_SE = "round(sqrt((regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_sxy({y}, {x})) / (regr_count({y}, {x}) - 2) / regr_sxx({y}, {x})), {r}) AS slope_se, round(regr_r2({y}, {x}), 6) AS r2"
_X = {"y": "l_extendedprice", "x": "l_quantity", "r": 4}
_EXPR = "WITH e AS (SELECT l_partkey % 50 AS gene, s_nationkey AS sample, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
#: Newton steps in SQL: {r} has a row a group and distinct (x, y) with its count w; mu and v are the mean and variance at b0 + b1 x.
_NEWTON = """, s(k, g, b0, b1) AS (SELECT 0, g, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM r GROUP BY g UNION ALL
      SELECT k + 1, g, b0 + (sxx * u0 - sx * u1) / (sw * sxx - sx * sx), b1 + (sw * u1 - sx * u0) / (sw * sxx - sx * sx) FROM
      (SELECT k, s.g, any_value(b0) AS b0, any_value(b1) AS b1, sum(w * ({v})) AS sw, sum(w * ({v}) * x) AS sx, sum(w * ({v}) * x * x) AS sxx, sum(w * (y - ({mu}))) AS u0, sum(w * (y - ({mu})) * x) AS u1 FROM s JOIN r ON s.g = r.g WHERE k < 12 GROUP BY k, s.g)),
      e AS (SELECT s.g, any_value(b0) AS b0, any_value(b1) AS b1, sum(w * ({v})) AS sw, sum(w * ({v}) * x) AS sx, sum(w * ({v}) * x * x) AS sxx, CAST(sum(w) AS BIGINT) AS n FROM s JOIN r ON s.g = r.g WHERE k = 12 GROUP BY s.g),
      t AS (SELECT g, n, 'intercept' AS term, b0 AS beta, sqrt(sxx / (sw * sxx - sx * sx)) AS se FROM e UNION ALL SELECT g, n, '{x}', b1, sqrt(sw / (sw * sxx - sx * sx)) FROM e)"""
_LOGIT = {"mu": "1 / (1 + exp(-b0 - b1 * x))", "v": "exp(-b0 - b1 * x) / pow(1 + exp(-b0 - b1 * x), 2)"}
ORACLES = {
    # Cramer's rule on the covariances of three columns
    "ols_multiple": "WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, var_pop(l_tax) AS cc, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_tax) AS ac, covar_pop(l_discount, l_tax) AS bc, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS yb, covar_pop(l_tax, l_extendedprice) AS cy FROM lineitem GROUP BY 1), d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s), b AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / det AS b1, (aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / det AS b2, (aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / det AS b3 FROM d), t AS (SELECT l_returnflag, n, unnest(['intercept', 'l_quantity', 'l_discount', 'l_tax']) AS term, unnest([my - b1 * m1 - b2 * m2 - b3 * m3, b1, b2, b3]) AS beta FROM b) SELECT l_returnflag, term, n, round(beta, 4) AS beta FROM t",
    "poisson_bootstrap": "WITH p AS (SELECT exp(-1) AS e), r AS (SELECT s_suppkey, CAST(k AS INTEGER) AS round, ((s_suppkey * 31 + k * 7919) % 2147483648 * 1103515245 + 12345) % 2147483648 / 2147483648.0 AS u FROM supplier, range(0, 3) t(k)), c AS (SELECT s_suppkey, round, CAST((u >= e)::INT + (u >= 2 * e)::INT + (u >= 2.5 * e)::INT + (u >= e * (2.5 + 1 / 6))::INT + (u >= e * (2.5 + 1 / 6 + 1 / 24))::INT + (u >= e * (2.5 + 1 / 6 + 1 / 24 + 1 / 120))::INT + (u >= e * (2.5 + 1 / 6 + 1 / 24 + 1 / 120 + 1 / 720))::INT AS INTEGER) AS times FROM r, p) SELECT * FROM c WHERE times > 0",
    "logistic": "WITH RECURSIVE r AS (SELECT l_linestatus AS g, l_quantity AS x, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, count(*) AS w FROM lineitem GROUP BY ALL)" + _NEWTON.format(x="l_quantity", **_LOGIT) + " SELECT g AS l_linestatus, term, n, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 5) AS z FROM t",
    "poisson": "WITH RECURSIVE o AS (SELECT l_orderkey, count(*) AS y, max(l_suppkey) % 5 AS x FROM lineitem GROUP BY 1), r AS (SELECT 1 AS g, x, y, count(*) AS w FROM o GROUP BY ALL)" + _NEWTON.format(x="x", mu="exp(b0 + b1 * x)", v="exp(b0 + b1 * x)") + " SELECT term, n, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 5) AS z FROM t",
    "ols_simple": "SELECT " + _REGR.format(k="l_returnflag", **_X) + ", round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, " + _SE.format(**_X) + ", round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) * (1.0 / count(*) + pow(avg(l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity))), 4) AS intercept_se FROM lineitem GROUP BY 1",
    "through_origin_3sigma": "WITH b AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS b FROM lineitem), e AS (SELECT l_quantity AS x, l_extendedprice AS y, l_extendedprice - b * l_quantity AS e FROM lineitem, b), s AS (SELECT stddev_samp(e) AS s FROM e) SELECT round(sum(x * y) / sum(x * x), 6) AS slope, count(*) AS n FROM e, s WHERE abs(e) <= 3 * s",
    "score_test": "WITH s AS (SELECT l_linestatus, count(*) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS xy, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx FROM lineitem GROUP BY 1) SELECT l_linestatus, n, round(pow(xy - p * sx, 2) / (p * (1 - p) * (sxx - sx * sx / n)), 6) AS score_chisq FROM s",
    "marker_scan": DOSAGES + ", r AS (SELECT marker, CAST((ind * 37 % 101) / 10.0 AS DOUBLE) AS y, dosage FROM g) SELECT " + _REGR.format(k="marker", y="y", x="dosage", r=6) + ", " + _SE.format(y="y", x="dosage", r=6) + " FROM r GROUP BY 1",
    "size_factors": _EXPR + ", g AS (SELECT gene, exp(avg(ln(n))) AS gm FROM e GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM e)) SELECT sample, round(quantile_cont(n / gm, 0.5), 6) AS size_factor FROM e JOIN g USING (gene) GROUP BY 1",
    "total_count_factors": _EXPR + ", t AS (SELECT sample, sum(n) AS t FROM e GROUP BY 1) SELECT sample, round(t / avg(t) OVER (), 6) AS size_factor FROM t",
    "rpkm": _EXPR + ", t AS (SELECT sample, sum(n) AS t FROM e GROUP BY 1) SELECT gene, sample, round(CASE WHEN gene < 45 THEN n * 1e9 / ((gene * 10 + 100) * t) ELSE 0.0 END, 4) AS rpkm FROM e JOIN t USING (sample)",
    "row_moments": _EXPR + " SELECT gene, round(avg(n), 6) AS mean, round(var_samp(n), 6) AS variance FROM e GROUP BY 1",
    "low_count_filter": _EXPR + " SELECT * FROM e WHERE gene IN (SELECT gene FROM e GROUP BY 1 HAVING count_if(n >= 45) >= 0.5 * (SELECT count(DISTINCT sample) FROM e))",
    "read_counting": """WITH r AS (SELECT event_id AS name, user_id % 10 AS chr, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 600 AS e, event_id % 40 AS mapq, CASE WHEN event_id % 14 = 0 THEN 2 ELSE 1 END AS nh FROM events WHERE event_id % 2 = 0),
      f AS (SELECT 'g' || (event_id % 30) AS gene, user_id % 10 AS chr, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 900 AS e FROM events WHERE event_id % 5 = 1),
      h AS (SELECT name, min(gene) AS lo, max(gene) AS hi FROM r JOIN f ON r.chr = f.chr AND r.s < f.e AND f.s < r.e GROUP BY 1),
      l AS (SELECT CASE WHEN nh > 1 THEN '__alignment_not_unique' WHEN mapq < 10 THEN '__too_low_aQual' WHEN lo IS NULL THEN '__no_feature' WHEN lo <> hi THEN '__ambiguous' ELSE lo END AS gene FROM r LEFT JOIN h USING (name)),
      n AS (SELECT DISTINCT gene FROM f UNION SELECT unnest(['__alignment_not_unique', '__too_low_aQual', '__no_feature', '__ambiguous'])) SELECT n.gene, count(l.gene) AS n FROM n LEFT JOIN l USING (gene) GROUP BY 1""",
    "hierarchy_ancestors": "WITH e AS (SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer) SELECT c AS node, p AS ancestor, 1 AS steps FROM e UNION ALL SELECT a.c, b.p, 2 FROM e a JOIN e b ON a.p = b.c",
}
