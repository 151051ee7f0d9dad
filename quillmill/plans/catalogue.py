"""Registered queries of the mail operators, each next to its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, *names: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` reads the views ``names``."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = with_views(sql.strip(), *names)
        return f

    return add


def oracle_of(f: Query) -> str:
    """The SQL of a query registered before, with its views: for another that gives the same rows."""
    return _sql[f.__name__]


def queries() -> dict[str, Query]:
    from quillmill.plans import intake, models, registry, stores, texts  # noqa: F401  they register their queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
