"""Filters (preset_id, ordinal, enabled, type, f, gain, q): responses, cascades, preamp, graphic EQ, cancellation, quantization."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dsp import MAGNITUDE, with_coefficients
from ..schema import HARD_MAX_FILTERS, MAX_GAIN_DB, MAX_HZ, MAX_Q, MIN_HZ, MIN_Q, SHELF_Q
from . import grids, presets


def responses(filters: DataFrame, grid: DataFrame, magnitude: str = MAGNITUDE) -> DataFrame:
    """preset_id, ordinal, idx, db of each filter (enabled or not) at every grid place; the grid is broadcast."""
    kept = with_coefficients(filters).withColumnRenamed("f", "fc")
    met = kept.crossJoin(F.broadcast(grid))  # a fixed grid, made on the driver
    return met.select("preset_id", "ordinal", "idx", "f", F.expr(magnitude).alias("db"))


def cascade(filters: DataFrame, grid: DataFrame) -> DataFrame:
    """preset_id, idx, f, db: the sum over enabled filters; zeros where none is.

    Rows are dealt by preset before they meet the grid, which is all that grouping by (preset, place) asks for, so the
    enlarged rows are never shuffled.
    """
    by_preset = filters.select("preset_id", "ordinal", "enabled", "type", "f", "gain", "q").repartition("preset_id")
    met = with_coefficients(by_preset).withColumnRenamed("f", "fc").crossJoin(F.broadcast(grid))
    level = F.when(F.col("enabled"), F.expr(MAGNITUDE)).otherwise(F.lit(0.0))
    return met.groupBy("preset_id", "idx").agg(F.first("f").alias("f"), F.sum(level).alias("db"))


def preamp(filters: DataFrame) -> DataFrame:
    """preset_id, preamp_db, max_boost_db, max_boost_hz on the dense grid of 16,384 places.

    A preset's filters (64 at most) travel as one array; the dense response is bounded by stretches and looked at only where its top can be.
    """
    found = presets.peaks(presets.packed(filters), grids.dense_grid())
    return found.select("preset_id", (-F.ceil(F.col("top_db") * 10 - 1e-10) / 10 + F.lit(0.0)).alias("preamp_db"), F.col("top_db").alias("max_boost_db"), F.col("top_hz").alias("max_boost_hz"))


def graphic_eq(filters: DataFrame, places: int | None = None) -> DataFrame:
    """preset_id, f, gain: averages of the cascade in bins around 127 frequencies, with the peak at 0 dB, rounded if asked.

    Which raw frequencies fall in which bin, and what an empty bin interpolates, depends on the fixed grids alone, so the
    bins are a product of the response with fixed weights.
    """
    raw, centres = grids.raw_frequencies(), grids.graphic_frequencies()
    bins = presets.binned(presets.packed(filters), raw, bin_weights(raw, centres), places)
    at = F.array(*[F.lit(float(x)) for x in centres])
    return bins.select("preset_id", F.posexplode("gain").alias("at", "gain")).select("preset_id", F.get(at, F.col("at")).alias("f"), "gain")


def graphic_items(filters: DataFrame) -> DataFrame:
    """preset_id, items: ``graphic_eq`` as texts, one row a preset."""
    raw, centres = grids.raw_frequencies(), grids.graphic_frequencies()
    return presets.binned_texts(presets.packed(filters), raw, centres, bin_weights(raw, centres))


def bin_weights(raw: list[float], centres: list[float]) -> list[list[tuple[int, float]]]:
    """For each bin the raw places and weights: a mean of those below its upper bound not used before, or a log-frequency interpolation."""
    out, at = [], 0
    for i, f in enumerate(centres):
        bound = np.sqrt(f * centres[i + 1]) if i + 1 < len(centres) else MAX_HZ
        start = at
        while at < len(raw) and raw[at] < bound:
            at += 1
        if at > start:
            out.append([(k, 1 / (at - start)) for k in range(start, at)])
        else:
            right = next(k for k, x in enumerate(raw) if x >= f)
            if raw[right] == f:
                out.append([(right, 1.0)])
            else:
                ratio = float(np.log(f / raw[right - 1]) / np.log(raw[right] / raw[right - 1]))
                out.append([(right - 1, 1 - ratio), (right, ratio)])
    return out


def valid_filter() -> Column:
    return F.col("f").between(MIN_HZ, MAX_HZ) & F.col("gain").between(-MAX_GAIN_DB, MAX_GAIN_DB) & F.col("q").between(MIN_Q, MAX_Q) & F.col("type").isin("PK", "LS", "HS")


def valid_presets(filters: DataFrame) -> DataFrame:
    """preset_id, n, ok: all filters within bounds, 64 at most; where filters have an ``id``, each holds something and none repeats."""
    fine = F.min(F.coalesce(valid_filter(), F.lit(False))) & (F.count(F.lit(1)) <= HARD_MAX_FILTERS)
    if "id" in filters.columns:
        fine &= F.min(F.coalesce(F.length(F.trim("id")) > 0, F.lit(False))) & (F.count_distinct("id") == F.count(F.lit(1)))
    return filters.groupBy("preset_id").agg(F.count(F.lit(1)).alias("n"), fine.alias("ok"))


def project_to_step(value: Column, step: float, lo: float, hi: float, lower_magnitude: bool) -> Column:
    """The nearest multiple of ``step`` within bounds; ties go to the lower value, or to the lower magnitude."""
    import math

    eps = 1e-10
    least, most = math.ceil(lo / step - eps), math.floor(hi / step + eps)
    if least > most:
        return F.lit(None).cast("double")
    clamp = lambda i: F.least(F.greatest(i, F.lit(least).cast("long")), F.lit(most).cast("long"))
    a, b = clamp(F.floor(value / step)), clamp(F.ceil(value / step))
    da, db = F.abs(value - a * step), F.abs(value - b * step)
    tie = (F.abs(b) < F.abs(a)) | ((F.abs(b) == F.abs(a)) & (b < a)) if lower_magnitude else b < a
    places = max(0, round(-math.log10(step)))
    return F.round(F.when((db < da - eps) | ((F.abs(db - da) <= eps) & tie), b).otherwise(a) * step, places) + 0.0


def quantize(filters: DataFrame) -> DataFrame:
    """Filters on manual-entry steps; shelves get their fixed Q."""
    return filters.withColumns({"f": project_to_step(F.col("f"), 1.0, MIN_HZ, MAX_HZ, False), "gain": project_to_step(F.col("gain"), 0.1, -MAX_GAIN_DB, MAX_GAIN_DB, True), "q": F.when(F.col("type") == "PK", project_to_step(F.col("q"), 0.01, MIN_Q, MAX_Q, False)).otherwise(F.lit(SHELF_Q))}).where("f IS NOT NULL AND gain IS NOT NULL AND q IS NOT NULL")


def round_half_up(value: Column, step: float, lo: float, hi: float) -> Column:
    """Ties go towards plus infinity; then bounds."""
    import math

    places = max(0, round(-math.log10(step)))
    index = F.least(F.greatest(F.floor(value / step + 0.5), F.lit(math.ceil(lo / step - 1e-10)).cast("long")), F.lit(math.floor(hi / step + 1e-10)).cast("long"))
    return F.round(index * step, places) + 0.0


def quantize_half_up(filters: DataFrame) -> DataFrame:
    """The second generation's quantization."""
    return filters.withColumns({"f": round_half_up(F.col("f"), 1.0, MIN_HZ, MAX_HZ), "gain": round_half_up(F.col("gain"), 0.1, -MAX_GAIN_DB, MAX_GAIN_DB), "q": F.when(F.col("type") == "PK", round_half_up(F.col("q"), 0.01, MIN_Q, MAX_Q)).otherwise(F.lit(SHELF_Q))})


def clamp_envelope(filters: DataFrame) -> DataFrame:
    """Filters clamped to the product's envelope; shelves get their fixed Q."""
    clamp = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), F.col(c)))
    return filters.withColumns({"f": clamp("f", MIN_HZ, MAX_HZ), "gain": clamp("gain", -MAX_GAIN_DB, MAX_GAIN_DB), "q": F.when(F.col("type") == "PK", clamp("q", MIN_Q, MAX_Q)).otherwise(F.lit(SHELF_Q))})


def type_order() -> Column:
    return F.when(F.col("type") == "LS", 0).when(F.col("type") == "PK", 1).otherwise(2)


def finalize(filters: DataFrame) -> DataFrame:
    """Filters in delivery order with new ids ``fit-n``: by frequency, type, |gain|, Q, then their old order."""
    w = Window.partitionBy("preset_id").orderBy("f", type_order(), F.abs("gain"), "q", "ordinal")
    return filters.withColumn("place", F.row_number().over(w)).withColumn("filter_id", F.concat(F.lit("fit-"), F.col("place")))


def canonical_places(filters: DataFrame) -> DataFrame:
    """``filters`` with place (from 1) by type, frequency and ``id``."""
    return filters.withColumn("place", F.row_number().over(Window.partitionBy("preset_id").orderBy(type_order(), "f", "id")))


def reorder(filters: DataFrame, moves: DataFrame) -> DataFrame:
    """``filters`` with new ordinals after one move a preset (preset_id, ordinal, up): the filter changes places with its neighbour; moves beyond an end do nothing.

    A preset has 64 filters at most, so its moves and its count are one row beside them.
    """
    move = moves.select("preset_id", F.col("ordinal").alias("_from"), F.when(F.col("up"), F.col("ordinal") - 1).otherwise(F.col("ordinal") + 1).alias("_to"))
    last = F.max("ordinal").over(Window.partitionBy("preset_id"))
    out = filters.withColumn("_last", last).join(move, "preset_id", "left")
    there = F.col("_from").between(0, F.col("_last")) & F.col("_to").between(0, F.col("_last"))
    new = F.when(F.coalesce(there, F.lit(False)) & (F.col("ordinal") == F.col("_from")), F.col("_to")).when(F.coalesce(there, F.lit(False)) & (F.col("ordinal") == F.col("_to")), F.col("_from")).otherwise(F.col("ordinal"))
    return out.withColumn("ordinal", new.cast("int")).drop("_from", "_to", "_last")


def result_rows(fits: DataFrame, filters: DataFrame, pairs: DataFrame) -> DataFrame:
    """``fits`` (preset_id and its metrics) with count, max_q, max_boost, moderate and strong of the delivered filters, all of which count as enabled."""
    own = filters.groupBy("preset_id").agg(F.count(F.lit(1)).alias("filter_count"), F.greatest(F.max("q"), F.lit(0.0)).alias("max_q"), F.greatest(F.max("gain"), F.lit(0.0)).alias("max_boost"))
    found = pairs.groupBy("preset_id").agg(F.count_if(F.col("severity") == "moderate").alias("moderate"), F.count_if(F.col("severity") == "strong").alias("strong"))
    out = fits.join(own, "preset_id", "left").join(found, "preset_id", "left")
    return out.na.fill(0, ["filter_count", "moderate", "strong"]).na.fill(0.0, ["max_q", "max_boost"])


def sort_by_frequency(filters: DataFrame) -> DataFrame:
    """A stable sort by frequency: new ordinals from 0, and whether the preset changed."""
    w = Window.partitionBy("preset_id").orderBy("f", "ordinal")
    old = Window.partitionBy("preset_id").orderBy("ordinal")
    out = filters.withColumns({"place": F.row_number().over(w) - 1, "was": F.row_number().over(old) - 1})
    return out.withColumn("changed", F.max(F.col("place") != F.col("was")).over(Window.partitionBy("preset_id"))).drop("was")
