"""What a workspace shows: the active pair's curves, the filters' effect, and how near it comes to the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import curves, metrics
from .sides import small_side


def derive(workspaces: DataFrame, points: DataFrame, prepared: DataFrame, eq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, states) of ``workspaces`` (workspace_id, fr_id, target_id).

    rows: workspace_id, idx, f, source, target, eq, result, residual of those that are ready. states: workspace_id, status (ready, incomplete or coverage-error) and
    mae, rmse, max_abs, max_abs_hz. ``prepared`` (curve_id, idx, f, db) has normalized curves, ``eq`` (workspace_id, idx, db) the filters' cascade, zero where missing.
    A curve that is not there leaves a workspace incomplete; one that does not cover the whole range is an error.
    """
    covers = curves.coverage(points).select("curve_id", "covers")
    side = lambda c: covers.select(F.col("curve_id").alias(c), F.col("covers").alias(f"{c}_covers"))
    known = workspaces.join(side("fr_id"), "fr_id", "left").join(side("target_id"), "target_id", "left")
    a, b = F.col("fr_id_covers"), F.col("target_id_covers")
    status = F.when(~F.coalesce(a, F.lit(True)) | ~F.coalesce(b, F.lit(True)), "coverage-error").when(a.isNull() | b.isNull(), "incomplete").otherwise("ready")
    known = known.select("workspace_id", "fr_id", "target_id", status.alias("status"))
    ready = known.where("status = 'ready'")
    target_ids = ready.select("target_id").distinct()
    targets = prepared.join(small_side(target_ids), F.col("curve_id") == F.col("target_id"), "left_semi").select(F.col("curve_id").alias("target_id"), "idx", F.col("db").alias("target"))
    rows = ready.join(prepared, F.col("fr_id") == F.col("curve_id")).select("workspace_id", "target_id", "idx", "f", F.col("db").alias("source")).join(targets, ["target_id", "idx"])
    rows = rows.join(eq.select("workspace_id", "idx", F.col("db").alias("eq")), ["workspace_id", "idx"], "left").withColumn("eq", F.coalesce("eq", F.lit(0.0)))
    rows = rows.withColumn("result", F.col("source") + F.col("eq")).withColumn("residual", F.col("target") - F.col("result"))
    found = metrics.error_metrics(rows.select("workspace_id", "idx", "f", F.col("residual").alias("db")), ["workspace_id"])
    return rows.drop("target_id"), known.select("workspace_id", "status").join(found, "workspace_id", "left")
