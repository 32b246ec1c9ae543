"""op2: the benchmark items leaked into every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.sources.tables import table

from . import decontaminate


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", F.col("leaks.item_id").alias("item_ids"), F.col("leaks.overlap").alias("overlaps"), (F.size("leaks") > 0).alias("contaminated"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES: dict[str, str] = {}
