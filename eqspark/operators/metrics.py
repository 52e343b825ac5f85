"""Error metrics of residuals (key, idx, f, db)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TARGET_MAX_ABS_DB, TARGET_RMSE_DB


def error_aggregates(value: Column | None = None) -> list[Column]:
    """mae, rmse, max_abs and max_abs_hz: the first frequency on ties."""
    x = F.col("db") if value is None else value
    top = F.max(F.struct(F.abs(x).alias("a"), (-F.col("idx")).alias("i"), F.col("f").alias("f")))
    return [F.avg(F.abs(x)).alias("mae"), F.sqrt(F.avg(x * x)).alias("rmse"), F.max(F.abs(x)).alias("max_abs"), top["f"].alias("max_abs_hz")]


def error_metrics(residuals: DataFrame, keys: list[str]) -> DataFrame:
    return residuals.groupBy(*keys).agg(*error_aggregates())


def band_metrics(residuals: DataFrame, keys: list[str], bands: list[tuple[str, float, float]]) -> DataFrame:
    """The metrics of each band, both ends included; a sample on a shared boundary counts in both.

    The few bands (a fixed list) are exploded in place of a range join.
    """
    inside = F.array(*[F.when(F.col("f").between(lo, hi), F.lit(name)) for name, lo, hi in bands])
    return residuals.withColumn("band", F.explode(F.filter(inside, lambda b: b.isNotNull()))).groupBy(*keys, "band").agg(*error_aggregates())


def target_achieved(rmse: Column, max_abs: Column) -> Column:
    return (rmse <= TARGET_RMSE_DB) & (max_abs <= TARGET_MAX_ABS_DB)


def violation(rmse: Column, max_abs: Column) -> Column:
    return F.greatest(rmse / TARGET_RMSE_DB, max_abs / TARGET_MAX_ABS_DB)


def distance(rmse: Column, max_abs: Column) -> Column:
    return F.hypot(rmse / TARGET_RMSE_DB, max_abs / TARGET_MAX_ABS_DB)


def filter_penalty() -> Column:
    """What a filter's own values add to the objective, whether it is enabled or not."""
    high_q, extra = F.greatest(F.lit(0.0), F.log2(F.col("q") / 2)), F.greatest(F.lit(0.0), F.abs("gain") - 6)
    return 0.01 + 0.002 * high_q * high_q + 0.0005 * extra * extra
