"""Query registry: name -> (Spark builder, oracle SQL or None).

A Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame. The
oracle SQL (DuckDB, over the test tables as views) computes the same rows
independently; entries without SQL are checked on row counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str  # inventory ids covered (SURVEY section 2)


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, ids: str):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # importing the catalogs fills the registry
    from ringlens.plans import catalog_calls, catalog_audit, catalog_clusters, catalog_sketches, catalog_steps, catalog_text  # noqa: F401
    return dict(_REGISTRY)
