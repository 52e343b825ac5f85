"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cleanup, materialize, shared_dir  # noqa: F401  (the operators take them from here)

#: White space is space, tab, newline, vertical tab, form feed, carriage return; a word is a run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: A broadcast side must have at most this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``, else as it is (a shuffled join, which AQE splits)."""
    return F.broadcast(df) if rows <= limit else df


def labelled(labels: DataFrame, mark: str, held_out: Column, salt: str, rows: int) -> DataFrame:
    """doc_id, y, h of at most ``rows`` labels of documents that are not ``held_out``, by a hash of the id; equal labels of a document count once.

    The labels are counted and those below a share of the hash's range are taken, so that no task sorts or holds more than it gives on.
    """
    h = F.xxhash64(F.col("doc_id").cast("long"), F.lit(salt))
    own = labels.where(F.col(mark).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(mark) > 0).cast("int").alias("y"), h.alias("h")).distinct()
    n = own.count()
    if n > rows:
        spare = max(0.5, 1 - 4 / rows**0.5)  # four deviations below the limit, which ``limit`` then hardly ever meets
        own = own.where(F.col("h") <= int(-(2**63) + spare * rows / n * 2**64)).limit(rows)
    return materialize(own, f"{salt}-sample")  # at most ``rows`` rows, so it may be broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
