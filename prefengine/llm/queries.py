"""Queries of the training-data problems and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_HOMES = {
    "p1_found": "pairs", "p2_found": "ranking", "p2_ranking": "ranking", "p2_agreement": "ranking", "p3_found": "splits", "p3_sources": "splits", "p4_found": "lookalike", "p4_forms": "lookalike",
    "p5_found": "neardup", "p5_groups": "neardup", "p6_found": "quotas", "p6_sample": "quotas", "p7_ids": "tokenize", "p8_found": "leakage", "p8_regions": "leakage",
    "p9_found": "subjects", "p9_mix": "subjects",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"prefengine.llm.{home}"), name) for name, home in _HOMES.items()}


def oracle_sql() -> dict[str, str]:
    from prefengine.llm.quotas import P6_SQL
    from prefengine.llm.ranking import P2_RANKING_SQL, P2_SQL

    return {"p2_found": P2_SQL, "p2_ranking": P2_RANKING_SQL, "p6_found": P6_SQL}
