"""The corpus pipeline: each stage works on what the one before it kept.

toxicity -> line dedup -> MinHash near-dedup -> benchmark decontamination -> best-fit packing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import common, decontaminate, line_dedup, near_dup, packing, toxicity
from helixframe.llm.q_packing import tokenizer_path
from helixframe.llm.q_toxicity import CATEGORIES
from helixframe.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, does not call toxic."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs, chain, out="_p").where(F.col("_p")[len(CATEGORIES) - 1] < chain.thresholds[-1]).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that came before; a document of which nothing is left goes, n_chars follows the text."""
    got = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = got.where((F.col("removed_lines") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 of 100 shingles), by id and word sequence; a row that repeats both stays once."""
    found = near_dup.near_duplicates(docs, percent=80).where("kept")
    name = lambda key: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.hex(key)).alias("_name")
    kept = docs.withColumn("_name", name(common.text_key(near_dup.canonical(F.col("text"))))).join(found.select(name(F.col("key"))), "_name", "left_semi")
    return kept.dropDuplicates(["_name"]).select(*COLUMNS)  # dealt out by _name already


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), out="_leaks")
    return found.where(F.size("_leaks") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token sequences of 1024."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]
#: Fitted models and rolling hashes are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents; each result is written and reread."""
    folder = f"{common.shared_dir(spark)}/helixframe/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with common.scratch(spark):  # what a stage wrote on the way goes; its result stays for the next
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
