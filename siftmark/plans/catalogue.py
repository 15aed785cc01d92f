"""The registered queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL_TWINS: dict[str, str] = {}

# Modules that register queries when imported.
FAMILIES = ["headline", "metric_queries", "record_queries", "comparison_queries", "feature_queries", "source_queries"]


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query, with the SQL that must give the same rows."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL_TWINS[name] = sql
        return build

    return register


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"siftmark.plans.{family}")
