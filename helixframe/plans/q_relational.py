"""Queries: keyed joins, merges and ordered lookups on orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import joins
from helixframe.sources.tables import table



def inner_join_lastwins(spark, d):
    build = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
    probe = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return joins.inner_join_last_wins(build, probe, "custkey", "o_orderkey").select("custkey", "c_name", F.round("o_totalprice", 2).alias("o_totalprice"))


def zip_by(spark, d):
    left = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    right = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.col("o_custkey").alias("o"))
    return joins.zip_by_key(left, right, "k", "o")


def merge_full_outer(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    parts = [o.where(F.col("v") % 3 == i) for i in range(3)]
    return joins.merge_full_outer(parts, "k", "v", "sum")


def merge_all_inputs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return joins.merge_all_inputs([o.where(F.col("o_orderkey") % 3 == i) for i in range(3)], "k")


def merge_maps(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(100).cast("long").alias("v"))
    return joins.merge_maps(o, c, "k", "v", lambda a, b: a + b)


def lag_asof(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    right = e.where("event_type = 'click'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    left = e.where("event_type <> 'click'").select("event_id", "user_id", "t")
    return joins.as_of(left, right, ["user_id"], "t", "value", "last_click").select("event_id", F.round("last_click", 6).alias("last_click"))


def insertion_interval(spark, d):
    p = table(spark, d, "part").select(F.col("p_retailprice").alias("x"))
    s = table(spark, d, "customer").where("c_acctbal > 0").select("c_acctbal")
    got = joins.insertion_interval(p, s, "x", "c_acctbal")
    return got.select(F.round("x", 2).alias("x"), F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"))


def nearby_loci(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("chr"), F.col("o_orderkey").alias("pos"))
    return joins.nearby(o, o, ["chr"], "pos", 2000).where("pos < pos_r").select("chr", "pos", "pos_r")


def compare_by_key(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.lit("?")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    return joins.compare_by_key(a, b, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def translate_ids(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("ID"), F.col("c_custkey") % 50, F.lit("."), F.col("c_custkey") % 3).alias("gene"))
    n = table(spark, d, "nation").select(F.concat(F.lit("ID"), F.col("n_nationkey")).alias("old"), "n_name")
    n = n.unionByName(table(spark, d, "region").select(F.concat(F.lit("ID"), F.col("r_regionkey")).alias("old"), F.col("r_name").alias("n_name")))
    return joins.translate_ids(c, "gene", n, "old", "n_name").select("c_custkey", "gene")


def fallback_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("k"))
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return joins.with_fallback(c, n, "k", "name", F.regexp_extract("c_name", r"#(\d+)$", 1)).select("c_custkey", "name")


def topk_per_group(spark, d):
    from helixframe.operators import sets

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sets.top_k(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000")
    has = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", F.lit("kept").alias("side"))
    not_ = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("dropped").alias("side"))
    return has.unionByName(not_)


QUERIES = {f.__name__: f for f in (inner_join_lastwins, zip_by, merge_full_outer, merge_all_inputs, merge_maps, lag_asof, insertion_interval, nearby_loci, compare_by_key, translate_ids, fallback_join, topk_per_group, semi_anti)}
ORACLES = {
    "inner_join_lastwins": "SELECT c_custkey AS custkey, c_name, round(arg_max(o_totalprice, o_orderkey), 2) AS o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "zip_by": "SELECT l_orderkey AS k, l_linenumber, o_orderstatus FROM lineitem JOIN (SELECT o_orderkey, arg_max(o_orderstatus, o_custkey) AS o_orderstatus FROM orders GROUP BY 1) ON l_orderkey = o_orderkey",
    "merge_full_outer": "WITH p AS (SELECT o_custkey AS k, o_orderkey % 3 AS i, min(o_orderkey) AS v FROM orders GROUP BY ALL) SELECT k, CAST(sum(v) AS BIGINT) AS v, count(*) AS n_inputs FROM p GROUP BY k",
    "merge_all_inputs": "SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) = 3",
    "merge_maps": "WITH o AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, CAST(100 AS BIGINT) AS v FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(o.k, c.k) AS k, coalesce(o.v + c.v, o.v, c.v) AS v FROM o FULL JOIN c ON o.k = c.k",
    "lag_asof": "WITH r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT event_id, round(r.value, 6) AS last_click FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts WHERE event_type <> 'click'",
    "insertion_interval": "WITH s AS (SELECT DISTINCT c_acctbal AS v FROM customer WHERE c_acctbal > 0), p AS (SELECT p_retailprice AS x, row_number() OVER () AS i FROM part) SELECT round(x, 2) AS x, round((SELECT max(v) FROM s WHERE v <= x), 2) AS lo, round((SELECT min(v) FROM s WHERE v > x), 2) AS hi FROM p",
    "nearby_loci": "SELECT a.o_custkey AS chr, a.o_orderkey AS pos, b.o_orderkey AS pos_r FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey AND b.o_orderkey - a.o_orderkey <= 2000",
    "compare_by_key": """WITH a AS (SELECT o_orderkey k, o_orderstatus s, o_orderpriority p FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 11 = 0 THEN '?' ELSE o_orderstatus END s, o_orderpriority p FROM orders WHERE o_orderkey % 7 <> 0)
      SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side, a.s IS NOT DISTINCT FROM b.s AS same_o_orderstatus, a.p IS NOT DISTINCT FROM b.p AS same_o_orderpriority FROM a FULL JOIN b ON a.k = b.k""",
    "translate_ids": """WITH n AS (SELECT 'ID' || n_nationkey AS old, n_name AS new FROM nation UNION ALL SELECT 'ID' || r_regionkey, r_name FROM region), s AS (SELECT old, min(new) AS new FROM n GROUP BY old HAVING count(DISTINCT new) = 1)
      SELECT c_custkey, coalesce(new, 'ID' || (c_custkey % 50) || '.' || (c_custkey % 3)) AS gene FROM customer LEFT JOIN s ON old = 'ID' || (c_custkey % 50)""",
    "fallback_join": "SELECT c_custkey, coalesce(n_name, regexp_extract(c_name, '#(\\d+)$', 1)) AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey",
    "topk_per_group": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3",
    "semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'kept' ELSE 'dropped' END AS side FROM customer",
}

#: On all customers.
