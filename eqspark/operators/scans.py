"""Running minima and neighbours over groups of any size: blocks first, then over the blocks, then within.

A group's rows are dealt into blocks that are contiguous in its order (``repartitionByRange`` by group and order, so a group with a third of all rows lies in a third of the
blocks, and rows of equal order in one). The minimum of each block is one row; a running minimum over these few, by group, says what comes before a block; a window
within (group, block) does the rest. No task gets more of a group than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .sides import small_side

#: Rows of a group that one window may hold; beyond it the scan has two levels.
BLOCK_ROWS = 200_000


def _blocks(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """``rows`` with _block, the number of the range they lie in. Written once: ranges come from a sample, and all later uses must see the same ones."""
    return materialize(rows.repartitionByRange(n, *keys, *order).withColumn("_block", F.spark_partition_id()), "scan-blocks")


def neighbours(rows: DataFrame, keys: list[str], order: list[str], value: Column, before: int, after: int, most: int | None = None) -> DataFrame:
    """``rows`` with _before1, ... and _after1, ...: ``value`` of the rows that many places before and after them, within ``keys``; null beyond the ends.

    Without ``most`` a group is one window partition. With it, groups are counted, and if one has more rows than that, the rows are dealt into blocks of about so many; the first and last
    rows of each block (as many as are asked for) go to the blocks beside it, so no task gets more of a group than a block and these borders.
    """
    own = rows.withColumn("_v", value)
    names = [*[(f"_before{k}", -k) for k in range(1, before + 1)], *[(f"_after{k}", k) for k in range(1, after + 1)]]
    total = None
    if most is not None:
        largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        total = largest[1] if (largest[0] or 0) > most else None
    if total is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return own.withColumns({name: F.lead("_v", k).over(w) if k > 0 else F.lag("_v", -k).over(w) for name, k in names}).drop("_v")
    blocks, group = _blocks(own, keys, order, -(-total // most)), [*keys, "_block"]
    inner = Window.partitionBy(*group).orderBy(*order)
    placed = blocks.withColumns({"_at": F.row_number().over(inner), "_n": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    border = placed.where((F.col("_at") <= max(after, 1)) | (F.col("_at") > F.col("_n") - max(before, 1)))
    # a group's borders are a few rows for each of its blocks
    edges = border.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "_v"))).alias("_edges"))
    spans = blocks.select(*group).distinct().join(edges, keys)
    beyond = spans.select(
        *group,
        F.slice(F.reverse(F.filter("_edges", lambda e: e["_block"] < F.col("_block"))), 1, max(before, 1)).alias("_left"),
        F.slice(F.filter("_edges", lambda e: e["_block"] > F.col("_block")), 1, max(after, 1)).alias("_right"),
    )
    met = blocks.join(small_side(materialize(beyond, "scan-borders")), group)
    met = met.withColumns({"_at": F.row_number().over(inner), "_n": F.count(F.lit(1)).over(Window.partitionBy(*group))})

    def of(k: int) -> Column:
        if k > 0:
            return F.when(F.col("_at") + k <= F.col("_n"), F.lead("_v", k).over(inner)).otherwise(F.get("_right", (F.col("_at") + k - F.col("_n") - 1).cast("int"))["_v"])
        return F.when(F.col("_at") + k >= 1, F.lag("_v", -k).over(inner)).otherwise(F.get("_left", (-k - F.col("_at")).cast("int"))["_v"])

    return met.withColumns({name: of(k) for name, k in names}).drop("_v", "_at", "_n", "_left", "_right", "_block")


def least_before(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, most: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``name``: the least ``value`` of those before them in ``order``, within ``keys``; null for a group's first row.

    ``value`` may be a struct. Groups are counted first; while all are within ``most`` rows, one window by group gives the same.
    """
    own = rows.withColumn("_v", value)
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (largest[0] or 0) <= most:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return own.withColumn(name, F.min("_v").over(before)).drop("_v")
    blocks, group = _blocks(own, keys, order, -(-largest[1] // most)), [*keys, "_block"]
    tops = blocks.groupBy(*group).agg(F.min("_v").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = materialize(tops.withColumn("_top", F.min("_top").over(earlier)), "scan-tops")  # a group has at most as many as there are blocks
    inner = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.min("_v").over(inner)
    return blocks.join(small_side(tops), group).withColumn(name, within).withColumn(name, F.least(name, "_top")).drop("_v", "_top", "_block")
