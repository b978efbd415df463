"""Named queries over the driver's tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` plus, where the result is
expressible in plain SQL, the equivalent DuckDB text over the same parquet
views.  Both sides alias every computed column to the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the catalog modules fills the two dicts.
    from sitelens.plans import catalog  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE_SQL)
