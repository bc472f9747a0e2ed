"""The queries of this subpackage: ``name -> (run, sql)``; ``sql`` is ``None`` where SQL has no form."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
MODULES = ("dedup_queries", "classifier_queries", "token_queries", "text_queries", "repeat_queries",
           "audit_queries")


def query(name: str, sql: str | None = None):
    """Register ``(spark, root) -> DataFrame`` under a name."""
    def add(run):
        REGISTRY[name] = (run, sql)
        return run
    return add


def load() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
    return REGISTRY
