"""Level mode of normalization: the offset at which a curve's loudness sum meets a level, by Newton's method as a fold over arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import iterate, let
from .fitting import loudness as tables
from .grids import loudness_grid

#: A step of at most this many dB ends the iteration.
STEP_DB, LIMIT = 0.01, 500
PER_DB = math.log(10) / 10


def flat_field(spark) -> DataFrame:
    """A free field without colour, as a table (place, level_db)."""
    return field_table(spark, tables.flat_free_field().tolist())


def field_table(spark, levels: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(levels)], "place int, level_db double")


def terms(field: DataFrame) -> DataFrame:
    """idx, alpha, offset, factor, field of each place of the loudness grid, from a free-field table (place, level_db): 480 rows."""
    import numpy as np

    f = loudness_grid()
    alpha, offset, factor, _ = tables.parameters(np.array(f), np.zeros(tables.FREE_FIELD_PLACES))
    spark = field.sparkSession
    places = np.clip(np.floor(0.5 + tables.FREE_FIELD_PER_OCTAVE * np.log2(np.array(f) / tables.FREE_FIELD_ORIGIN_HZ)), 0, tables.FREE_FIELD_PLACES - 1).astype(int)
    base = spark.createDataFrame([(i, int(p), *map(float, x)) for i, (p, *x) in enumerate(zip(places, alpha, offset, factor, strict=True))], "idx int, place int, alpha double, offset double, factor double")
    return base.join(F.broadcast(field.select("place", F.col("level_db").alias("field"))), "place", "left").drop("place")  # a fixed table


def offsets(points: DataFrame, level_db: float, field: DataFrame | Sequence[float], key: str = "curve_id") -> DataFrame:
    """key, offset of curves (key, idx, f, db) on the loudness grid, against their level, in a free field (a table or its levels); curves that do not cover the whole grid have none.

    A curve's places are gathered (480 at most) and the iteration is a fold in its row. A sum that cannot be inverted, or no end after 500 steps, raises.
    """
    if not isinstance(field, DataFrame):
        field = field_table(points.sparkSession, list(field))
    n = len(loudness_grid())
    met = points.join(F.broadcast(terms(field)), "idx")  # a fixed table
    rows = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("db") - F.col("field")).alias("over"), "alpha", "offset", "factor"))).alias("p")).where(F.size("p") == n)

    def step(x: Column) -> Column:
        def add(total: Column, p: Column) -> Column:
            power = F.exp(PER_DB * (p["over"] + x))
            def both(raised: Column) -> Column:
                inner = p["offset"] + raised
                cube = inner * inner * inner
                return F.struct((total["sum"] + p["factor"] * cube * inner).alias("sum"), (total["slope"] + p["factor"] * 4 * cube * p["alpha"] * raised * PER_DB).alias("slope"))

            return let(F.pow(power, p["alpha"]), both)

        sums = F.aggregate("p", F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("slope")), add)
        fine = lambda t: (t["sum"] > 0) & (t["slope"] != 0) & (F.abs(t["sum"]) < float("inf")) & (F.abs(t["slope"]) < float("inf"))
        return let(sums, lambda t: F.when(fine(t), x - (F.log(t["sum"]) - level_db * PER_DB) * t["sum"] / t["slope"]))

    found = iterate(F.lit(0.0), step, lambda a, b: b.isNull() | (F.abs(b - a) <= STEP_DB), LIMIT)
    out = rows.select(key, found.alias("r"))
    bad = F.when(F.col("r.x").isNull(), F.raise_error(F.lit("numeric: the loudness sum cannot be inverted"))).when(~F.col("r.done"), F.raise_error(F.lit("numeric: the loudness offset did not converge")))
    return out.select(key, F.coalesce(bad.cast("double"), F.col("r.x") - level_db).alias("offset"))
