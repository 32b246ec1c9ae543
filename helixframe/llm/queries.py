"""Registered queries of the corpus operators: op<N>_<name>(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_line_dedup", "q_decontaminate", "q_url_filter", "q_near_dup", "q_toxicity", "q_suffix_dedup", "q_vector_search", "q_warc_audit", "q_packing", "q_html_extract", "q_lm_scoring", "q_filter_audit", "q_fill_in_middle")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out.update(import_module(f"{__package__}.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"{__package__}.{name}").ORACLES)
    return out
