"""The named queries of the library, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "bh_adjust"
MODULES = ("helixframe.plans.q_multitest", "helixframe.plans.q_relational", "helixframe.plans.q_intervals", "helixframe.plans.q_stats", "helixframe.plans.q_genotype", "helixframe.plans.q_sequence", "helixframe.plans.q_models", "helixframe.plans.q_frames", "helixframe.plans.q_formats", "helixframe.plans.q_scans", "helixframe.plans.q_association", "helixframe.plans.q_clusters", "helixframe.plans.q_rows")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out.update(import_module(name).QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(name).ORACLES)
    return out
