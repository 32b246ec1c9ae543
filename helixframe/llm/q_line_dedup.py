"""op1: all documents without repeated runs of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.sources.tables import table

from . import line_dedup


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return got.select("doc_id", F.octet_length(kept).cast("long").alias("n_bytes"), F.col("removed_lines"), F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES: dict[str, str] = {}
