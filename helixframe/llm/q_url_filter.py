"""op3: every page's URL under the stated rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.sources.tables import table

from . import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules, keep=("page_id",))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {
    "op3_url_filter": f"""
    WITH rules(h, p, v) AS (VALUES {_VALUES}),
    rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, url FROM rest),
    judged AS (SELECT host, path, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS verdict
      FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
    SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN judged ON parts.host = judged.host AND parts.path = judged.path"""
}
