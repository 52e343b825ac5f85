"""Interpolation, normalization and derivation of curves in long form (curve_id, idx, f, db)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MIN_HZ
from .scans import neighbours
from .sides import small_side


def segments(points: DataFrame, key: str = "curve_id", carry: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """One row for each pair of neighbours: key, ``carry`` (columns that a key determines), l, ldb, r, rdb, is_last.

    With ``most``, curves of more points than that are spread over tasks (``scans.neighbours``).
    """
    met = neighbours(points, [key], ["f"], F.struct("f", "db"), 0, 2, most)
    out = met.select(key, *carry, F.col("f").alias("l"), F.col("db").alias("ldb"), F.col("_after1.f").alias("r"), F.col("_after1.db").alias("rdb"), F.col("_after2").isNull().alias("is_last"))
    return out.where("r IS NOT NULL")


def lerp(f: Column) -> Column:
    """The value at ``f`` within a segment; its ends are exact."""
    ratio = F.log(f / F.col("l")) / F.log(F.col("r") / F.col("l"))
    return F.when(f == F.col("l"), F.col("ldb")).when(f == F.col("r"), F.col("rdb")).otherwise(F.col("ldb") + ratio * (F.col("rdb") - F.col("ldb")))


def interpolate_grid(points: DataFrame, grid: DataFrame, points_per_octave: int, key: str = "curve_id", most: int | None = None) -> DataFrame:
    """key, idx, f, db of each curve at the frequencies of a logarithmic grid that it covers.

    A segment knows by arithmetic which grid places lie in it, so it explodes to those and reads their exact
    frequencies by a broadcast equi-join: the work is the size of the result, not segments times grid.
    """
    return on_grid(segments(points, key, most=most), grid, points_per_octave).select(key, "idx", "f", "db")


def on_grid(parts: DataFrame, grid: DataFrame, points_per_octave: int) -> DataFrame:
    """The columns of ``parts`` (segments) with idx, f, db of the grid places in each."""
    n = grid.count()  # a grid is a driver-made table of fixed size
    place = lambda f: F.log2(F.col(f) / MIN_HZ) * points_per_octave
    lo, hi = F.greatest(F.floor(place("l")).cast("int") - 1, F.lit(0)), F.least(F.ceil(place("r")).cast("int") + 1, F.lit(n - 1))
    spread = parts.where(lo <= hi).withColumn("idx", F.explode(F.sequence(lo, hi)))
    met = spread.join(F.broadcast(grid.select("idx", "f")), "idx").where(_holds(F.col("f")))
    return met.withColumn("db", lerp(F.col("f")))


def _holds(f: Column) -> Column:
    """Whether a segment has ``f``; the last one has its right end, too."""
    return (f >= F.col("l")) & ((f < F.col("r")) | (F.col("is_last") & (f == F.col("r"))))


def interpolate_at(points: DataFrame, frequency: Column | float, key: str = "curve_id") -> DataFrame:
    """key, db at one frequency of every curve that covers it."""
    f = F.lit(frequency) if isinstance(frequency, float) else frequency
    return segments(points, key).where(_holds(f)).select(key, lerp(f).alias("db"))


def interpolate_asof(points: DataFrame, wanted: DataFrame, key: str = "curve_id", how: str = "left") -> DataFrame:
    """key, f, db of each row of ``wanted`` (key, f); outside the coverage db is null (how='left') or the row is dropped ('inner').

    Points and wanted frequencies are merged in one sorted pass for each curve (a window), so that no pairs are made.
    """
    both = points.select(key, "f", "db", F.lit(0).alias("side")).unionByName(wanted.select(key, "f", F.lit(None).cast("double").alias("db"), F.lit(1).alias("side")))
    before = Window.partitionBy(key).orderBy("f", "side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(F.col("f").desc(), "side").rowsBetween(Window.unboundedPreceding, 0)  # growing frames are one pass, shrinking ones are not
    known = F.when(F.col("side") == 0, F.struct(F.col("f").alias("f"), F.col("db").alias("db")))
    out = both.withColumns({"_l": F.last(known, ignorenulls=True).over(before), "_r": F.last(known, ignorenulls=True).over(after)}).where("side = 1")
    out = out.select(key, "f", F.col("_l.f").alias("l"), F.col("_l.db").alias("ldb"), F.col("_r.f").alias("r"), F.col("_r.db").alias("rdb"))
    out = out.select(key, "f", F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), lerp(F.col("f"))).alias("db"))
    return out.where("db IS NOT NULL") if how == "inner" else out


def normalization_offset_hz(points: DataFrame, frequency_hz: float, key: str = "curve_id") -> DataFrame:
    """key, offset: what brings the curve to 0 dB at the anchor (the level does not matter in this mode)."""
    return interpolate_at(points, frequency_hz, key).select(key, (-F.col("db")).alias("offset"))


def prepare(points: DataFrame, grid: DataFrame, points_per_octave: int, frequency_hz: float, key: str = "curve_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, ``carry``, idx, f, db: on the grid, with the offset of the raw points added; curves that do not cover the anchor are dropped.

    The offset is a window over a curve's segments, which are in one place for their neighbours already: nothing is joined or shuffled for it.
    """
    at = F.lit(frequency_hz)
    offset = F.max(F.when(_holds(at), -lerp(at))).over(Window.partitionBy(key))
    parts = segments(points, key, carry).withColumn("offset", offset).where("offset IS NOT NULL")
    return on_grid(parts, grid, points_per_octave).select(key, *carry, "idx", "f", (F.col("db") + F.col("offset")).alias("db"))


def prepare_level(points: DataFrame, offsets: DataFrame, grid: DataFrame, points_per_octave: int, key: str = "curve_id") -> DataFrame:
    """``prepare`` with an offset (key, offset) for each curve, as the level mode of normalization gives it; curves without one are dropped."""
    parts = segments(points, key).join(small_side(offsets), key)
    return on_grid(parts, grid, points_per_octave).select(key, "idx", "f", (F.col("db") + F.col("offset")).alias("db"))


def combine(left: DataFrame, right: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Element-wise ``value`` of ``left.db`` (a) and ``right.db`` (b) by grid place."""
    a, b = left.withColumnRenamed("db", "a"), right.drop("f").withColumnRenamed("db", "b")
    return a.join(b, keys).withColumn(name, value).drop("a", "b")


def desired(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """target - source."""
    return combine(source, target, keys, F.col("b") - F.col("a"), "db")


def apply_eq(source: DataFrame, eq: DataFrame, keys: list[str]) -> DataFrame:
    """source + eq."""
    return combine(source, eq, keys, F.col("a") + F.col("b"), "db")


def residual(wanted: DataFrame, eq: DataFrame, keys: list[str]) -> DataFrame:
    """wanted - eq: positive where the target is above the result."""
    return combine(wanted, eq, keys, F.col("a") - F.col("b"), "db")


def valid_points(points: DataFrame, key: str = "curve_id", most: int | None = None) -> DataFrame:
    """key, ok: finite positive rising frequencies, finite levels, two points at least; ``idx`` gives the order. With ``most``, longer curves are spread over tasks."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rising = F.coalesce(F.col("_before1") < F.col("f"), F.lit(True))
    marked = neighbours(points, [key], ["idx"], F.col("f"), 1, 0, most).select(key, (finite("f") & finite("db") & (F.col("f") > 0) & rising).alias("ok"))
    return marked.groupBy(key).agg((F.min("ok") & (F.count(F.lit(1)) >= 2)).alias("ok"))


def coverage(points: DataFrame, key: str = "curve_id") -> DataFrame:
    """key, lo, hi, covers: whether the curve spans the whole range."""
    return points.groupBy(key).agg(F.min("f").alias("lo"), F.max("f").alias("hi")).withColumn("covers", (F.col("lo") <= 20) & (F.col("hi") >= 20_000))


def last_duplicate_wins(points: DataFrame, key: str = "curve_id") -> DataFrame:
    """Valid points with the last of each frequency, by ``idx``."""
    w = Window.partitionBy(key, "f").orderBy(F.col("idx").desc())
    fine = points.where("f > 0 AND NOT isnan(f) AND NOT isnan(db) AND abs(f) < double('infinity') AND abs(db) < double('infinity')")
    return fine.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def collapse_duplicates(points: DataFrame, key: str = "curve_id") -> DataFrame:
    """key, f, db, conflict: equal frequencies once; conflict where their levels differ."""
    return points.groupBy(key, "f").agg(F.min("db").alias("db"), (F.min("db") != F.max("db")).alias("conflict"))


def display_offsets(points: DataFrame, offsets: DataFrame, key: str = "curve_id") -> DataFrame:
    """Points with each curve's display offset (0 where it has none) added."""
    return points.join(offsets, key, "left").withColumn("db", F.col("db") + F.coalesce("offset", F.lit(0.0))).drop("offset")


#: Places an octave at which a baseline's segments are looked up.
LOOKUP_PLACES = 48


def against_baseline(points: DataFrame, baseline: DataFrame) -> DataFrame:
    """Points minus a baseline curve (f, db) at their frequencies; points that it does not cover are dropped.

    The baseline is one curve. Its segments are spread over logarithmic places and met by place, so no task gets all points.
    """
    place = lambda f: F.floor(F.log2(F.col(f)) * LOOKUP_PLACES).cast("int")
    parts = segments(baseline.withColumn("_b", F.lit(0)), "_b").withColumn("place", F.explode(F.sequence(place("l"), place("r")))).drop("_b")
    met = points.withColumn("place", place("f")).join(small_side(parts), "place").where(_holds(F.col("f")))
    return met.select(*[c for c in points.columns if c != "db"], (F.col("db") - lerp(F.col("f"))).alias("db"))


def resampled(points: DataFrame, key: str = "curve_id") -> DataFrame:
    """key, f, db on the display grid of each curve (48 places an octave inside its range, and its own ends); curves with fewer than three places stay as they are."""
    from .grids import display_grid

    places = display_grid(points.withColumnRenamed(key, "curve_id")).withColumnRenamed("curve_id", key)
    at = interpolate_asof(points, places, key, "inner")
    few = at.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n < 3")
    return at.join(few, key, "left_anti").unionByName(points.select(key, "f", "db").join(few, key, "left_semi"))
