"""All registered queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import curve_queries, filter_queries, research_queries, state_queries  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
