"""op5: every document's category probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.sources.tables import table

from . import toxicity

#: The label columns that there are, in the order of the chain; the last one is what is asked for.
CATEGORIES = ("quality", "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    p = toxicity.score(docs, chain, out="p").select("doc_id", "p")
    return p.select("doc_id", F.col("p")[0].alias("p_quality"), F.col("p")[1].alias("p_toxic"), (F.col("p")[1] >= chain.thresholds[1]).alias("toxic"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
