"""Queries: interval algebra on event sessions (user as chromosome, seconds as coordinate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import intervals, sets
from helixframe.sources.tables import table


def sessions(spark, d, kind=None):
    e = table(spark, d, "events")
    e = e.where(F.col("event_type") == kind) if kind else e
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("chr"), s.alias("start"), (s + 1800 + F.col("event_id") % 3600).alias("end"))


def interval_collapse(spark, d):
    return intervals.collapse(sessions(spark, d), "chr")


def interval_collapse_gap(spark, d):
    return intervals.collapse(sessions(spark, d), "chr", gap=86400)


def interval_overlap_join(spark, d):
    a, b = sessions(spark, d, "click"), sessions(spark, d, "purchase")
    return intervals.overlap_join(a, b, "chr", 7200)


def points_in_regions(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("chr"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))
    r = intervals.collapse(sessions(spark, d, "purchase"), "chr")
    return intervals.points_in(e, r, "chr", "pos", 7200).select("event_id", "chr", "pos", "start", "end")


def interval_subtract(spark, d):
    return intervals.subtract(sessions(spark, d, "click"), sessions(spark, d, "view"), "chr")


def interval_intersect(spark, d):
    return intervals.intersect(sessions(spark, d, "click"), sessions(spark, d, "view"), "chr")


def interval_union(spark, d):
    return intervals.union(sessions(spark, d, "click"), sessions(spark, d, "view"), "chr")


def interval_coverage(spark, d):
    return intervals.coverage(sessions(spark, d), "chr").where("depth > 1")


def interval_chunk(spark, d):
    return intervals.chunk(sessions(spark, d), 1000)


def interval_midpoints(spark, d):
    return intervals.midpoints(sessions(spark, d)).withColumn("mid", F.col("mid").cast("long"))


def interval_total_length(spark, d):
    return intervals.total_length(sessions(spark, d))


def sliding_row_windows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("chr"), "o_orderkey")
    return intervals.row_windows(o, "chr", "o_orderkey", 10, 5).groupBy("chr", F.col("win").cast("long").alias("win")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def sliding_coord_windows(spark, d):
    return intervals.coordinate_windows(intervals.collapse(sessions(spark, d), "chr"), "chr", 3600, 1800)


def span_grouping(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    got = sets.span_groups(e, ["user_id"], "event_id", F.col("event_type") == "click")
    return got.select("event_id", "span")


_S = "SELECT user_id AS chr, (epoch_us(ts) // 1000000) AS \"start\", (epoch_us(ts) // 1000000) + 1800 + event_id % 3600 AS \"end\", event_type FROM events"
_COLLAPSE = """, {n}g AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS f FROM {src}),
  {n}i AS (SELECT *, sum(f) OVER (PARTITION BY chr ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM {n}g), {n} AS (SELECT chr, min("start") AS "start", max("end") AS "end" FROM {n}i GROUP BY chr, isl)"""
_ENDS = """, m AS (SELECT chr, "start" AS pos, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS a, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS b FROM s WHERE event_type IN ('click', 'view')
    UNION ALL SELECT chr, "end", CASE WHEN event_type = 'click' THEN -1 ELSE 0 END, CASE WHEN event_type = 'view' THEN -1 ELSE 0 END FROM s WHERE event_type IN ('click', 'view')),
  p AS (SELECT chr, pos, sum(a) AS a, sum(b) AS b FROM m GROUP BY chr, pos),
  seg AS (SELECT chr, pos AS "start", lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS "end", sum(a) OVER (PARTITION BY chr ORDER BY pos) AS na, sum(b) OVER (PARTITION BY chr ORDER BY pos) AS nb FROM p)"""

QUERIES = {f.__name__: f for f in (interval_collapse, interval_collapse_gap, interval_overlap_join, points_in_regions, interval_subtract, interval_intersect, interval_union, interval_coverage, interval_chunk, interval_midpoints, interval_total_length, sliding_row_windows, sliding_coord_windows, span_grouping)}
ORACLES = {
    "interval_collapse": f"WITH s AS ({_S})" + _COLLAPSE.format(n="c", gap=0, src="s") + " SELECT * FROM c",
    "interval_collapse_gap": f"WITH s AS ({_S})" + _COLLAPSE.format(n="c", gap=86400, src="s") + " SELECT * FROM c",
    "interval_overlap_join": f"WITH s AS ({_S}) SELECT a.chr, a.\"start\", a.\"end\", b.\"start\" AS start_b, b.\"end\" AS end_b FROM s a JOIN s b ON a.chr = b.chr AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.\"start\" < b.\"end\" AND b.\"start\" < a.\"end\"",
    "points_in_regions": f"WITH s AS ({_S}), q AS (SELECT * FROM s WHERE event_type = 'purchase')" + _COLLAPSE.format(n="c", gap=0, src="q") + " SELECT event_id, c.chr, (epoch_us(ts) // 1000000) AS pos, \"start\", \"end\" FROM events JOIN c ON user_id = chr AND (epoch_us(ts) // 1000000) >= \"start\" AND (epoch_us(ts) // 1000000) < \"end\"",
    "interval_subtract": f"WITH s AS ({_S})" + _ENDS + ", q AS (SELECT * FROM seg WHERE na > 0 AND nb = 0 AND \"end\" IS NOT NULL)" + _COLLAPSE.format(n="c", gap=0, src="q") + " SELECT * FROM c",
    "interval_intersect": f"WITH s AS ({_S})" + _ENDS + ", q AS (SELECT * FROM seg WHERE na > 0 AND nb > 0 AND \"end\" IS NOT NULL)" + _COLLAPSE.format(n="c", gap=0, src="q") + " SELECT * FROM c",
    "interval_union": f"WITH s AS ({_S}), q AS (SELECT * FROM s WHERE event_type IN ('click', 'view'))" + _COLLAPSE.format(n="c", gap=0, src="q") + " SELECT * FROM c",
    "interval_coverage": f"WITH s AS ({_S}), m AS (SELECT chr, \"start\" AS pos, 1 AS a FROM s UNION ALL SELECT chr, \"end\", -1 FROM s), p AS (SELECT chr, pos, sum(a) AS a FROM m GROUP BY chr, pos), seg AS (SELECT chr, pos AS \"start\", lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS \"end\", CAST(sum(a) OVER (PARTITION BY chr ORDER BY pos) AS BIGINT) AS depth FROM p) SELECT * FROM seg WHERE depth > 1",
    "interval_chunk": f"WITH s AS ({_S}) SELECT chr, x AS \"start\", least(x + 1000, \"end\") AS \"end\" FROM (SELECT chr, \"end\", unnest(range(\"start\", \"end\", 1000)) AS x FROM s)",
    "interval_midpoints": f"WITH s AS ({_S}) SELECT chr, \"start\", \"end\", (\"start\" + \"end\") // 2 AS mid FROM s",
    "interval_total_length": f"WITH s AS ({_S}) SELECT CAST(sum(\"end\" - \"start\") AS BIGINT) AS total_length FROM s",
    "sliding_row_windows": """WITH o AS (SELECT o_orderpriority AS chr, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders),
      w AS (SELECT chr, unnest(range(0, max(n) // 5 + 1)) AS win FROM o GROUP BY chr) SELECT w.chr, win, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM w JOIN o ON o.chr = w.chr AND o.n >= win * 5 AND o.n < win * 5 + 10 GROUP BY w.chr, win""",
    "sliding_coord_windows": f"WITH s AS ({_S})" + _COLLAPSE.format(n="c", gap=0, src="s") + " SELECT chr, x AS win_start, least(x + 3600, \"end\") AS win_end FROM (SELECT chr, \"end\", unnest(range(\"start\", \"end\", 1800)) AS x FROM c)",
    "span_grouping": "WITH e AS (SELECT event_id, user_id, CASE WHEN (event_type = 'click') <> lag(event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM events) SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span FROM e",
}
