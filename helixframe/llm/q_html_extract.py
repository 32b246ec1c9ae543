"""op10: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.sources.tables import table

from . import html_extract


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extract": op10_html_extract}
ORACLES: dict[str, str] = {}
