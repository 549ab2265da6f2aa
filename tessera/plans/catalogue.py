"""Queries of the engine's own operators and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ("corpus", "retrieval", "answers", "evaluation", "reports", "store")


def _areas():
    return [importlib.import_module(f"tessera.plans.{a}") for a in AREAS]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of every question: keyword, semantic, structured and graph search, fused and reranked."""
    from tessera.plans import retrieval

    return retrieval.four_list_evidence(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for a in _areas() for k, v in a.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for a in _areas() for k, v in a.SQL.items()}
