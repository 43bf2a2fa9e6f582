"""Registry of named queries: Spark plan + (optional) DuckDB oracle SQL.

``__spark_entry__`` exposes this registry to the driver. Every query reads
the driver's tables (through the fixture builders), so its work grows with
the scale factor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load():
    # Importing the query modules fills the registry.
    from .plans import branch_queries, costs, enrich_queries, report_queries, selection, shortlist, text_queries  # noqa: F401
