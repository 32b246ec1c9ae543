"""op8: pages as WARC records, audited against a replica with known damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.sources.tables import table

from . import warc_audit


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica's files lack the records of ids that leave 11 by 199 and hold another first letter of the page in those that leave 5 by 97; the rest stands where it did."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    other = F.concat(F.when(F.left(html, F.lit(1)) == "!", "?").otherwise("!"), F.substring(html, 2, 1 << 30))
    damaged = F.when((F.col("page_id") % 97 == 5) & (html != ""), other).otherwise(html)
    theirs = warc_audit.warc_record(F.col("page_id"), F.col("url"), damaged)
    placed = warc_audit.placed(warc_audit.hashed(pages, their_hash=warc_audit.sha256(theirs)), ("their_hash",))
    replica = placed.where("id % 199 <> 11").withColumn("sha256", F.col("their_hash"))
    got = warc_audit.audit(placed, replica)
    return got.withColumnRenamed("id", "page_id")


QUERIES = {"op8_merkle_audit": op8_merkle_audit}
ORACLES = {
    "op8_merkle_audit": """
    WITH r AS (SELECT coalesce(page_id, -1) AS id, coalesce(html, '') <> '' AS filled, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
        || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages),
    d AS (SELECT id, filled, sha256(rec) AS sha256, CAST(strlen(rec) AS BIGINT) AS length, count(*) AS copies FROM r GROUP BY ALL)
    SELECT id AS page_id, CAST(floor(id / 4096) AS BIGINT) AS file_id,
      CAST(coalesce(sum(length * copies) OVER (PARTITION BY CAST(floor(id / 4096) AS BIGINT) ORDER BY id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
      length, sha256, copies, CASE WHEN id % 199 = 11 THEN 'missing' WHEN id % 97 = 5 AND filled THEN 'corrupt' ELSE 'intact' END AS status FROM d"""
}
