"""op6: all documents without byte strings of 400 that start elsewhere too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.sources.tables import table

from . import suffix_dedup


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.repeated_spans(docs, 400).withColumn("spans", suffix_dedup._merged("spans"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["hi"] - s["lo"]).cast("long"))
    found = found.select("t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(suffix_dedup.cut("text", "spans"), 256).alias("kept_sha256"), (F.size("spans") > 0).alias("has_repeats"))
    return docs.select("doc_id", *suffix_dedup.text_id(F.col("text"))).join(found, ["t1", "t2"]).drop("t1", "t2")


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
