"""Every query of the core library with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``, with the SQL that gives the same rows."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is defined twice")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    """Import the modules that register queries."""
    from tarnstone.queries import codebase, compositions, entries, everywhere, lifecycle, more, records, relational, scalars, search  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
