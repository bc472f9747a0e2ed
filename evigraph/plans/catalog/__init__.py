"""Named queries over the shared tables, each with the SQL that must give the same rows.

A query keeps the survey rows it covers in ``covers``. ``sql`` is ``None`` where the result
cannot be written in SQL; such queries are compared with brute force in the tests.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

AREAS = ("retrieval", "text", "graphs", "evaluation", "operations", "streams")


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function ``(spark, root) -> DataFrame`` under a name."""
    def add(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, covers, run, sql)
        return run
    return add


def load() -> dict[str, Query]:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return REGISTRY
