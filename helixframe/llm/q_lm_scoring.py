"""op11: every document's log10 probability under word counts and under a recurrent network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.sources.tables import table

from . import lm_scoring

#: The documents that training leaves out; a null id counts as empty text.
HELD_OUT = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 = 2"


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"), HELD_OUT)


QUERIES = {"op11_lm_scoring": op11_lm_scoring}
ORACLES: dict[str, str] = {}
