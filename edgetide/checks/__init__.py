"""The registered queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL over the views of ``checks.views`` when there is any."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            from edgetide.checks.views import with_views
            SQL[name] = with_views(sql)
        return fn
    return add


def load() -> None:
    from edgetide.checks import (boosted, eviction, metrics, models, scalars, scans, streams,  # noqa: F401
                                 trace, traffic, views)
