"""op4: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.sources.tables import table

from . import near_dup


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("key")


QUERIES = {"op4_near_dup": op4_near_dup}
ORACLES = {
    "op4_near_dup": r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
    sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM sets),
    flat AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
    links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
    heads AS (SELECT u, min(v) AS head FROM reach GROUP BY u)
    SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(head, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(head, doc_id)) AS kept FROM sized LEFT JOIN heads ON doc_id = u"""
}
