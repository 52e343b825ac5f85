"""Join sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A broadcast side must have at most this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows (counted unless given) are within ``limit``, else as it is: a shuffled join, which AQE splits."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df
