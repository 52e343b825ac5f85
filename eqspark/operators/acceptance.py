"""Rules by which runs, results and baselines are accepted. All are column expressions, false (never null) where a part is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_GAIN_DB, MAX_HZ, MAX_Q, MIN_HZ, MIN_Q

SETTINGS = ("minFrequencyHz", "maxFrequencyHz", "minGainDb", "maxGainDb", "minQ", "maxQ", "maxFilters", "timeLimitSeconds")
DEFAULTS = {"minFrequencyHz": MIN_HZ, "maxFrequencyHz": MAX_HZ, "minGainDb": -MAX_GAIN_DB, "maxGainDb": MAX_GAIN_DB, "minQ": MIN_Q, "maxQ": MAX_Q, "maxFilters": 10}
#: Marker of a structural run: preset and seeds.
STRUCTURAL = ("max10-q31-b4-p8-experimental", "zero-start")
DRIFT = 1e-5


def _all(rules: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False))


def valid_response_input(f: Column, rate_hz: float) -> Column:
    """A positive rate, and frequencies (an array) above 0 and below half of it."""
    return _all([F.lit(0 < rate_hz < float("inf")), F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < rate_hz / 2))])


def structural_eligible(settings: Column) -> Column:
    """Only default settings with ten filters may take the structural search; the time limit is free."""
    return _all([settings[n] == v for n, v in DEFAULTS.items()])


def same_normalization(a: Column, b: Column) -> Column:
    return _all([a[n].eqNullSafe(b[n]) for n in ("mode", "frequencyHz", "levelDb")])


def same_settings(a: Column, b: Column) -> Column:
    return _all([a[n].eqNullSafe(b[n]) for n in SETTINGS])


def same_filters(a: Column, b: Column) -> Column:
    """Equal filters in equal order, ids included."""
    return F.coalesce(a == b, F.lit(False))


def valid_result(result: Column, valid_manifest: Column) -> Column:
    """A result (filters, metrics, preampDb, manifest) whose payload is its manifest's, with unique ids within the manifest's cap."""
    own, said = result["filters"], result["manifest"]
    ids = F.transform(own, lambda x: x["id"])
    return _all([valid_manifest, F.size(own) <= said["autoeqSettings"]["maxFilters"], F.size(F.array_distinct(ids)) == F.size(own), own == said["finalFilters"], result["metrics"] == said["metrics"], result["preampDb"] == said["preampDb"]])


def matches_captured(manifest: Column, taken: Column, structural: Column) -> Column:
    """Whether a manifest was made from the inputs ``taken`` (sourceName, targetName, normalization, settings) and in the way asked for."""
    marker = manifest["experimental"]
    as_asked = F.when(structural, (marker["preset"] == STRUCTURAL[0]) & (marker["seedMode"] == STRUCTURAL[1])).otherwise(marker.isNull())
    return _all(
        [manifest["schemaVersion"] == 3, manifest["algorithmVersion"] == "standard-v2", as_asked, manifest["sourceName"].eqNullSafe(taken["sourceName"]), manifest["targetName"].eqNullSafe(taken["targetName"])]
        + [same_normalization(manifest["normalization"], taken["normalization"]), same_settings(manifest["autoeqSettings"], taken["settings"])]
    )


def same_hashes(hashes: Column, expected: Column) -> Column:
    """Two maps with the same names and values."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return F.coalesce(entries(hashes) == entries(expected), F.lit(False))


def compatible_baseline(identity: Column, expected: Column, versions: dict[str, int], aggregates: Column) -> Column:
    """A baseline that may be compared: schema 1, a commit, the same versions and corpus, and rows."""
    return _all([identity["schemaVersion"] == 1, F.length(identity["implementationCommit"]) > 0, *[identity[n] == v for n, v in versions.items()], same_hashes(identity["corpusHashes"], expected), aggregates.isNotNull()])


def drifted(claimed: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = DRIFT) -> DataFrame:
    """Claimed metrics (mae, rmse, max_abs, max_abs_hz) that differ by more than ``tolerance`` from those recomputed, or have none: keys, worst.

    Where no deviation is above ``tolerance``, its place is rounding noise and does not count.
    """
    names = ("mae", "rmse", "max_abs", "max_abs_hz")
    met = claimed.join(recomputed.select(*keys, *[F.col(n).alias(f"_{n}") for n in names]), keys, "left")
    far = lambda n: F.coalesce(F.abs(F.col(n) - F.col(f"_{n}")), F.lit(float("inf")))
    place = F.when(F.greatest("max_abs", "_max_abs") <= tolerance, 0.0).otherwise(far("max_abs_hz"))
    worst = F.greatest(far("mae"), far("rmse"), far("max_abs"), place)
    return met.select(*keys, worst.alias("worst")).where(F.col("worst") > tolerance)


def strict_metrics(claimed: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = DRIFT) -> DataFrame:
    """``claimed``; reading it raises if any row has drifted."""
    bad = drifted(claimed, recomputed, keys, tolerance).withColumn("_bad", F.lit(True)).drop("worst")
    out = claimed.join(bad, keys, "left")
    first = keys[0]
    return out.withColumn(first, F.when(F.col("_bad").isNull(), F.col(first)).otherwise(F.raise_error(F.lit("numeric: metrics differ from the delivered residual")))).drop("_bad")
