"""Named queries over the driver's tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_views(*views: str) -> str:
    """``WITH`` and the views of the bridge, by name or as ``name AS (...)``."""
    from ..sources.bridge import SQL

    return "WITH " + ",\n".join(SQL.get(v, v) for v in views) + "\n"
