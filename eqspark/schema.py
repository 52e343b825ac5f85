"""Limits, defaults, table types and the error helper."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_RATE_HZ = 48_000.0
MIN_HZ, MAX_HZ = 20.0, 20_000.0
POINTS_PER_OCTAVE = 96
MAX_GAIN_DB = 15.0
MIN_Q, MAX_Q = 0.1, 12.0
DEFAULT_FILTERS, HARD_MAX_FILTERS = 10, 64
TIME_LIMITS_S = (5, 15, 30, 60, 120)
SHELF_Q = 0.7
TARGET_RMSE_DB, TARGET_MAX_ABS_DB = 0.25, 0.75
#: Manual-entry steps: frequency, gain, Q, preamp.
STEP_HZ, STEP_DB, STEP_Q, STEP_PREAMP_DB = 1.0, 0.1, 0.01, 0.1
TYPE_ORDER = {"LS": 0, "PK": 1, "HS": 2}
#: (type, frequency, gain, Q) of a new filter.
FILTER_DEFAULTS = {"PK": (1000.0, 0.0, 1.0), "LS": (105.0, 0.0, 0.7), "HS": (10_000.0, 0.0, 0.7)}

METRIC_BANDS = [("20-5k", 20.0, 5000.0), ("20-8k", 20.0, 8000.0), ("20-10k", 20.0, 10_000.0), ("20-14k", 20.0, 14_000.0), ("20-20k", 20.0, 20_000.0)]
RESEARCH_BANDS = [("bass", 20.0, 200.0), ("low-mid", 200.0, 1000.0), ("mid", 1000.0, 4000.0), ("presence", 4000.0, 8000.0), ("treble", 8000.0, 20_000.0)]
ZOOM_RANGES = [("full", 20.0, 20_000.0), ("bass", 20.0, 400.0), ("midrange", 100.0, 4000.0), ("treble", 1000.0, 20_000.0)]
TIMELINE_MARKS_MS = (500, 1000, 2000, 3000, 5000, 10_000, 15_000, 20_000, 30_000, 45_000, 60_000)

POINT = T.StructType([T.StructField("frequency_hz", T.DoubleType()), T.StructField("db", T.DoubleType())])
CURVES = T.StructType([T.StructField("curve_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("raw_points", T.ArrayType(POINT)), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
FILTERS = T.StructType([T.StructField("preset_id", T.LongType()), T.StructField("ordinal", T.IntegerType()), T.StructField("enabled", T.BooleanType()), T.StructField("type", T.StringType()), T.StructField("f", T.DoubleType()), T.StructField("gain", T.DoubleType()), T.StructField("q", T.DoubleType())])

ERROR_CATEGORIES = ("parse", "validation", "optimization", "numeric", "export")


class EqError(ValueError):
    """An error with one of ``ERROR_CATEGORIES``."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


def check(df: DataFrame, ok: Column, category: str, message: str, strict: bool = False) -> DataFrame:
    """``df`` with error_category and error_message; strict: reading a bad row raises instead."""
    if strict:
        first = df.columns[0]
        return df.withColumn(first, F.when(ok, F.col(first)).otherwise(F.raise_error(F.lit(f"{category}: {message}"))))
    old = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("error_category", "error_message")}
    return df.withColumns({"error_category": F.coalesce(old["error_category"], F.when(~ok, F.lit(category))), "error_message": F.coalesce(old["error_message"], F.when(~ok, F.lit(message)))})


@dataclass(frozen=True)
class Settings:
    """What a user sets for a fit."""

    min_hz: float = MIN_HZ
    max_hz: float = MAX_HZ
    min_gain: float = -MAX_GAIN_DB
    max_gain: float = MAX_GAIN_DB
    min_q: float = MIN_Q
    max_q: float = MAX_Q
    max_filters: int = DEFAULT_FILTERS
    time_limit_s: int = 60

    def valid(self, timed: bool = True) -> bool:
        """Within the product's limits, with every minimum strictly below its maximum."""
        import math

        numbers = (self.min_hz, self.max_hz, self.min_gain, self.max_gain, self.min_q, self.max_q, self.max_filters)
        if not all(math.isfinite(x) for x in numbers):
            return False
        inside = MIN_HZ <= self.min_hz < self.max_hz <= MAX_HZ and -MAX_GAIN_DB <= self.min_gain < self.max_gain <= MAX_GAIN_DB and MIN_Q <= self.min_q < self.max_q <= MAX_Q
        whole = float(self.max_filters).is_integer() and 0 <= self.max_filters <= HARD_MAX_FILTERS
        return inside and whole and (not timed or self.time_limit_s in TIME_LIMITS_S)

    def with_filters(self, n: int) -> Settings:
        return replace(self, max_filters=n)

    def with_limit(self, seconds: int) -> Settings:
        return replace(self, time_limit_s=seconds)


@dataclass(frozen=True)
class Normalization:
    mode: str = "hz"
    frequency_hz: float = 500.0
    level_db: float = 60.0
