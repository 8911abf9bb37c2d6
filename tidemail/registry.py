"""Registry of named queries with their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and reads the given tables
(whole tables, no id subsets or row caps).  ``sql`` is the equivalent query
over the same parquet files as DuckDB views; ``None`` marks operators that
SQL cannot express (model training, streaming), which get a rows-only check.
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
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    import tidemail.queries  # noqa: F401  (registers everything)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import tidemail.queries  # noqa: F401
    return dict(_SQL)
