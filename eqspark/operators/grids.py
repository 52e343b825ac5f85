"""Frequency grids. They are made on the driver in double arithmetic (a few hundred to 16,384 rows, whatever the data) and broadcast."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MAX_HZ, MIN_HZ, POINTS_PER_OCTAVE, EqError


def log_grid(min_hz: float, max_hz: float, points_per_octave: float) -> list[float]:
    """min * 2^(i / points), with both ends exact, so that the last step is short."""
    if not (math.isfinite(min_hz) and min_hz > 0 and math.isfinite(max_hz) and max_hz > min_hz and math.isfinite(points_per_octave) and points_per_octave > 0):
        raise EqError("validation", "a grid needs 0 < minimum < maximum and positive points per octave")
    last = math.ceil(math.log2(max_hz / min_hz) * points_per_octave)
    return [min_hz, *(min_hz * 2 ** (i / points_per_octave) for i in range(1, last)), max_hz]


def evaluation_grid() -> list[float]:
    return log_grid(MIN_HZ, MAX_HZ, POINTS_PER_OCTAVE)


def loudness_grid() -> list[float]:
    return log_grid(MIN_HZ, MAX_HZ, 48)


def dense_grid(n: int = 16_384) -> list[float]:
    """The preamp grid."""
    return [MIN_HZ, *(MIN_HZ * (MAX_HZ / MIN_HZ) ** (i / (n - 1)) for i in range(1, n - 1)), MAX_HZ]


def raw_frequencies() -> list[float]:
    return [MIN_HZ * 1.0072**i for i in range(math.ceil(math.log(MAX_HZ / MIN_HZ) / math.log(1.0072)))]


def graphic_frequencies() -> list[float]:
    n = math.ceil(math.log(MAX_HZ / MIN_HZ) / math.log(1.0563))
    return sorted({float(math.floor(MIN_HZ * 1.0563**i)) for i in range(n)})


def grid_frame(spark: SparkSession, frequencies: list[float]) -> DataFrame:
    """idx, f and the sines of each frequency, for broadcasting."""
    from ..functions.dsp import GRID, apply_steps

    base = spark.createDataFrame([(i, float(x)) for i, x in enumerate(frequencies)], "idx int, f double")
    return apply_steps(base, GRID).drop("w")


def display_grid(points: DataFrame, points_per_octave: int = 48) -> DataFrame:
    """curve_id, f: 20 * 2^(k / 48) strictly inside each curve's coverage, and its own two ends."""
    ends = points.groupBy("curve_id").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    step = lambda f: F.log2(F.col(f) / MIN_HZ) * points_per_octave
    # a curve's places are an array in its row: at most 480 within the range, made from its two ends, and nothing is shuffled for them
    at = F.transform(F.sequence(F.floor(step("lo")).cast("int"), F.ceil(step("hi")).cast("int")), lambda k: MIN_HZ * F.pow(F.lit(2.0), k / points_per_octave))
    inner = F.filter(at, lambda f: (f > F.col("lo")) & (f < F.col("hi")))
    return ends.select("curve_id", F.explode(F.array_distinct(F.concat(F.array("lo"), inner, F.array("hi")))).alias("f"))
