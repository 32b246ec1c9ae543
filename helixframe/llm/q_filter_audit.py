"""op12: what five filters remove, in every order, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.sources.tables import table

from . import filter_audit


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {
    "op12_filter_audit": r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS m FROM d LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, m, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY 1, 2),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
    o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
    s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step]) AS upto FROM o, range(1, 6) r(step)),
    p AS (SELECT c.part, filter_order, step, s.bit, sum(CASE WHEN m & upto::INT = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN m & upto::INT = s.bit THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN m & s.bit > 0 AND m & (upto::INT - s.bit) > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN m = s.bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN m & upto::INT = s.bit THEN c.good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN m & upto::INT = s.bit THEN c.toxic ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM p"""
}
