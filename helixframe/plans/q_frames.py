"""Queries: row and column work, pair sets, chunks and multivariate summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import frames, sets
from helixframe.plans.q_genotype import _G as DOSAGES
from helixframe.plans.q_genotype import dosages
from helixframe.plans.q_multitest import pseudo_p
from helixframe.sources import sinks
from helixframe.sources.tables import table


def include_exclude(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    return frames.include_exclude(c, "k", n.where("n_regionkey < 3"), n.where("k % 4 = 0")).select("c_custkey")


def regex_or_list(spark, d):
    return frames.matching(table(spark, d, "part"), "p_name", "^red .*t$", ["small ring"]).select("p_partkey")


def drop_unsound(spark, d):
    c = table(spark, d, "customer").withColumn("x", F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 11 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")))
    return frames.drop_unsound(c, ["x"]).select("c_custkey")


def dummy_code(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    got = frames.dummy_code(o, "o_orderstatus", "o_orderkey")
    return got.select("o_orderkey", F.array_join(F.array(*[F.col(c).cast("int") for c in sorted(got.columns) if c.startswith("o_orderstatus_")]), "").alias("code"))


def long_to_wide(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return frames.long_to_wide(li, "l_suppkey", "l_returnflag", "n", ["A", "N", "R"]).select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


def has_variance(spark, d):
    return frames.has_variance(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal")


def bind_columns(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus")
    b = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderpriority")
    return frames.bind_columns([a, b], "o_orderkey")


def common_elements(spark, d):
    li = table(spark, d, "lineitem")
    return frames.common_elements([li.where(F.col("l_returnflag") == f).select("l_partkey") for f in "ANR"], "l_partkey")


def marker_pairs(spark, d):
    m = table(spark, d, "supplier").select("s_suppkey")
    return frames.ordered_pairs(m, "s_suppkey", (F.col("s_suppkey") % 4).cast("int"), 4)


def arm_chunks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("chr"), F.col("o_orderkey").alias("pos"))
    got = frames.chunk_by_arm(o, "chr", "pos", F.lit(2000), 300, 20)
    return got.groupBy("chr", "arm", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def phase_blocks(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return frames.phase_blocks(e, ["user_id"], "event_id", F.col("event_type") != "error").select("event_id", "block")


def covariances(spark, d):
    got = frames.covariance(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_tax"])
    return got.select("l_returnflag", "x", "y", (F.round("covariance", 3) + 0.0).alias("covariance"))


def mahalanobis(spark, d):
    return frames.mahalanobis2(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("d2", 6).alias("d2"))


def cosine_pairs(spark, d):
    """Every twentieth vector against all others."""
    v = table(spark, d, "embeddings")
    got = frames.cosine_pairs(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding")
    return got.select("a", "b", F.round("inner", 5).alias("inner"), F.round("cosine", 5).alias("cosine"))


def regulated(spark, d):
    p = pseudo_p(spark, d).withColumn("fold", (F.col("o_orderkey") * 31 % 1000) / 100.0 - 5)
    return frames.regulated(p, "p", "fold", 0.05, 1.0).select("o_orderkey", "side")


def burden(spark, d):
    return frames.burden(dosages(spark, d), "ind", "marker", "dosage").select("ind", F.round("burden", 4).alias("burden"))


def variant_density(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("chr"), F.col("o_orderkey").alias("pos"))
    return frames.variant_density(o, "chr", "pos", 500)


def significant_rows(spark, d):
    return sinks.significant(pseudo_p(spark, d), "p", 0.01).select("o_orderkey")


def order_violations(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sets.verify_sorted(o, ["o_custkey"], ["o_orderkey"], "o_totalprice").select("o_orderkey")


QUERIES = {f.__name__: f for f in (include_exclude, regex_or_list, drop_unsound, dummy_code, long_to_wide, has_variance, bind_columns, common_elements, marker_pairs, arm_chunks, phase_blocks, covariances, mahalanobis, cosine_pairs, regulated, burden, variant_density, significant_rows, order_violations)}

_P = "SELECT o_orderkey, x * x * x AS p FROM (SELECT o_orderkey, CAST((o_orderkey * 48271 % 2147483647) / 2147483647.0 AS DOUBLE) AS x FROM orders)"
ORACLES = {
    "include_exclude": "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3 AND n_nationkey % 4 <> 0",
    "regex_or_list": "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^red .*t$') OR p_name = 'small ring'",
    "drop_unsound": "SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0",
    "dummy_code": "WITH l AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY min(o_orderkey)) AS r FROM orders GROUP BY 1) SELECT o_orderkey, (SELECT string_agg(CASE WHEN l.s = o_orderstatus THEN '1' ELSE '0' END, '' ORDER BY l.s) FROM l WHERE r > 1) AS code FROM orders",
    "long_to_wide": "SELECT l_suppkey, nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS a, nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS n, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS r FROM lineitem GROUP BY 1",
    "has_variance": "SELECT c_nationkey, min(c_acctbal) <> max(c_acctbal) AS has_variance FROM customer GROUP BY 1",
    "bind_columns": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "common_elements": "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3",
    "marker_pairs": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey",
    "arm_chunks": """WITH o AS (SELECT o_orderstatus AS chr, o_orderkey AS pos, CASE WHEN o_orderkey < 2000 THEN 'p' ELSE 'q' END AS arm FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY chr, arm ORDER BY pos) - 1 AS n, count(*) OVER (PARTITION BY chr, arm) AS m FROM o),
      l AS (SELECT *, greatest(0, m // 300 - CASE WHEN m % 300 < 150 OR m % 300 = 0 THEN 1 ELSE 0 END) AS last FROM n), c AS (SELECT *, least(n // 300, last) AS own FROM l),
      u AS (SELECT chr, arm, pos, own AS chunk FROM c UNION ALL SELECT chr, arm, pos, own + 1 FROM c WHERE own < last AND (own + 1) * 300 - n <= 20) SELECT chr, arm, chunk, count(*) AS n, min(pos) AS first, max(pos) AS last FROM u GROUP BY 1, 2, 3""",
    "phase_blocks": "SELECT event_id, CAST(2 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM events",
    "covariances": " UNION ALL ".join(f"SELECT l_returnflag, '{x}' AS x, '{y}' AS y, round(covar_samp({x}, {y}), 3) + 0.0 AS covariance FROM lineitem GROUP BY 1" for i, x in enumerate(("l_quantity", "l_extendedprice", "l_tax")) for y in ("l_quantity", "l_extendedprice", "l_tax")[i:]),
    "mahalanobis": "WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS vx, var_samp(l_extendedprice) AS vy, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, round((pow(l_quantity - mx, 2) * vy - 2 * (l_quantity - mx) * (l_extendedprice - my) * c + pow(l_extendedprice - my, 2) * vx) / (vx * vy - c * c), 6) AS d2 FROM lineitem, s",
    "cosine_pairs": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e), 5) AS inner, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 5) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0",
    "regulated": f"WITH p AS (SELECT o_orderkey, p, CAST((o_orderkey * 31 % 1000) / 100.0 AS DOUBLE) - 5 AS f FROM ({_P})) SELECT o_orderkey, CASE WHEN f > 1 THEN 'up' ELSE 'down' END AS side FROM p WHERE p <= 0.05 AND (f > 1 OR f < -1)",
    "burden": DOSAGES + ", f AS (SELECT marker, sum(dosage) > count(dosage) AS flip FROM g GROUP BY 1) SELECT ind, round(sum(CASE WHEN flip THEN 2 - dosage ELSE dosage END), 4) AS burden FROM g JOIN f USING (marker) GROUP BY 1",
    "variant_density": "SELECT o_orderstatus AS chr, o_orderkey // 500 * 500 AS win_start, count(*) AS n FROM orders GROUP BY 1, 2",
    "significant_rows": f"SELECT o_orderkey FROM ({_P}) WHERE p <= 0.01",
    "order_violations": "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE o_totalprice < b",
}
