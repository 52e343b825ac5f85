"""Plans of research runs: cases, cells and repeats in; run rows, checks, aggregates, warnings and artefacts out.

A budget of seconds is a budget of evaluations (``EVALUATIONS_PER_S``), and elapsed time is counted in evaluations, so that runs do not depend on the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POINTS_PER_OCTAVE, SAMPLE_RATE_HZ, EqError, Normalization, Settings
from ..sources import curve_text, report
from ..storage import materialize
from . import acceptance, curves, filters, grids, metrics, presets, research
from .fits import fit_pairs, packed, preamp_of
from .fitting.v2 import COUNTERS
from .sides import small_side

EVALUATIONS_PER_S = 400
CASE_KEYS = ["case_id", "budget_s", "max_filters", "repeat"]
FILTER = "struct<type:string,f:double,gain:double,q:double>"
RUN = (
    "case_id string, budget_s int, max_filters int, repeat int, mode string, elapsed_ms double, mae double, rmse double, max_abs double, max_abs_hz double, achieved boolean, termination string, preamp_db double, "
    f"filters array<{FILTER}>, counters map<string,long>, checkpoints array<struct<elapsed_ms:double,mae:double,rmse:double,max_abs:double,max_abs_hz:double,n:int>>"
)


# --- cases -------------------------------------------------------------------------------------


def synthetic_cases(wished: DataFrame, grid: DataFrame, solvable: int = 10, places: int | None = None) -> DataFrame:
    """case_id, category, idx, f, source, target, desired: what filters do (preset_id is the case) is what is desired, so the source is its opposite and the target flat.

    Cases with at most ``solvable`` filters are solvable, the others stress. Levels are rounded to ``places`` if asked.
    """
    frequencies = [r.f for r in grid.select("idx", "f").orderBy("idx").collect()]  # a grid is a driver-made table of fixed size
    kind = F.when(F.count_if("enabled") <= solvable, "solvable").otherwise("stress").alias("category")
    level = presets.cascades(presets.packed(wished, kind), frequencies, places).select("preset_id", "category", F.posexplode("db").alias("idx", "db"))
    f = F.get(F.array(*[F.lit(x) for x in frequencies]), F.col("idx"))
    return level.select(F.col("preset_id").alias("case_id"), "category", "idx", f.alias("f"), (-F.col("db") + F.lit(0.0)).alias("source"), F.lit(0.0).alias("target"), F.col("db").alias("desired"))


def research_cases(source: DataFrame, targets: DataFrame, frequency_hz: float) -> DataFrame:
    """case_id, idx, f, db: one source curve (curve_id, f, db) against each target, both prepared; the case is the target's curve_id."""
    if source.select("curve_id").distinct().count() != 1:
        raise EqError("validation", "a plan has one source curve")
    grid = grids.grid_frame(source.sparkSession, grids.evaluation_grid())
    ready = lambda points: curves.prepare(points, grid, POINTS_PER_OCTAVE, frequency_hz)
    one = ready(source).select("idx", F.col("db").alias("source"))  # a curve on a fixed grid
    return ready(targets).join(F.broadcast(one), "idx").select(F.col("curve_id").alias("case_id"), "idx", "f", (F.col("db") - F.col("source")).alias("db"))


def load_cases(spark: SparkSession, source_path: str, target_paths: dict[str, str], frequency_hz: float = 500.0) -> DataFrame:
    """``research_cases`` of curve text files: case name to the path of its target. Bad files raise."""

    if not target_paths:
        raise EqError("validation", "a plan has targets")
    named = [curve_text.read_texts(spark, path).select(F.lit(name).alias("name"), F.lit(is_source).alias("is_source"), "text") for name, path, is_source in [("source", source_path, True), *((n, p, False) for n, p in target_paths.items())]]
    # the files are few, and parsed together: one plan, whatever their number
    texts = reduce(DataFrame.unionByName, named).withColumn("key", F.struct("is_source", "name"))
    parsed = curve_text.strict(curve_text.parse_curves(texts, "key"))
    rows = materialize(parsed.select("key.*", F.posexplode("points").alias("idx", "p")).select("is_source", F.col("name").alias("curve_id"), "idx", F.col("p.frequency_hz").alias("f"), F.col("p.db").alias("db")), "cases")
    return research_cases(rows.where("is_source").drop("is_source"), rows.where("NOT is_source").drop("is_source"), frequency_hz)


# --- runs --------------------------------------------------------------------------------------


def run_plan(cases: DataFrame, cells: DataFrame, repeats: int = 1, engine: str = "v2") -> DataFrame:
    """A row (``RUN``) for each cell (case_id, budget_s, max_filters, mode) and repeat. Engines: v2, structural, or none (no filters, for tests of a plan).

    ``cases``: case_id, idx, f, db. Cells meet their case's two arrays; every row is fitted by itself, spread over all cores.
    """

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .fitting import structural, v2
        from .fitting.v1 import Fit

        for batch in batches:
            rows = []
            for r in batch.itertuples():
                f, db = np.asarray(r.f, np.float64), np.asarray(r.db, np.float64)
                settings, limit = Settings(max_filters=int(r.max_filters)), int(r.budget_s) * EVALUATIONS_PER_S
                told = v2.Telemetry()
                if engine == "v2":
                    got, used, why, told = v2.traced_fit(f, db, settings, limit)
                elif engine == "structural":
                    got, used, why = structural.fit(f, db, settings, limit)
                else:
                    got, used, why = Fit([], *v2.metrics(db, f), []), 0, "converged"
                ms = 1000 / EVALUATIONS_PER_S
                points = [dict(zip(("elapsed_ms", "mae", "rmse", "max_abs", "max_abs_hz", "n"), (c[0] * ms, *c[1:6]), strict=True)) for c in told.checkpoints]
                own = [dict(zip(("type", "f", "gain", "q"), x, strict=True)) for x in got.filters]
                achieved = got.rmse <= 0.25 and got.max_abs <= 0.75
                rows.append((r.case_id, r.budget_s, r.max_filters, r.repeat, r.mode, used * ms, got.mae, got.rmse, got.max_abs, got.max_abs_hz, achieved, why, preamp_of(got.filters), own, {c: int(told.counts[c]) for c in COUNTERS}, points))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RUN.replace(f"array<{FILTER}>", "x").split("checkpoints")[0].split(", ")[:-1]] + ["checkpoints"])

    inputs = packed(cases.withColumn("case_id", F.col("case_id").cast("string")), "case_id")
    every = cells.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("case_id", F.col("case_id").cast("string"))
    spread = 4 * cells.sparkSession.sparkContext.defaultParallelism
    met = every.join(small_side(inputs), "case_id").select("case_id", F.col("budget_s").cast("int").alias("budget_s"), F.col("max_filters").cast("int").alias("max_filters"), "repeat", "mode", "f", "db")
    return met.repartition(spread, *CASE_KEYS).mapInPandas(fits, RUN)


def structural_results(wanted: DataFrame, normalization: Normalization = Normalization(), settings: Settings = Settings(), max_evaluations: int = 20_000, key: str = "pair_id") -> DataFrame:
    """key, filters, metrics, preampDb, manifest of the structural search of each wanted correction (key, idx, f, db), as a session keeps them. Settings other than the default ones raise."""
    if settings.with_limit(60) != Settings():
        raise EqError("validation", "the structural search takes default settings only")
    got = fit_pairs(wanted, "structural", settings, max_evaluations, key)
    d = lambda x: F.lit(float(x))
    own = F.transform("filters", lambda x, i: F.struct(F.concat(F.lit("fit-"), i + 1).alias("id"), F.lit(True).alias("enabled"), x["type"].alias("type"), x["f"].alias("frequencyHz"), x["gain"].alias("gainDb"), x["q"].alias("q")))
    measured = F.struct(F.col("mae").alias("maeDb"), F.col("rmse").alias("rmseDb"), F.col("max_abs").alias("maxAbsDb"), F.col("max_abs_hz").alias("maxAbsFrequencyHz"))
    values = (settings.min_hz, settings.max_hz, settings.min_gain, settings.max_gain, settings.min_q, settings.max_q, settings.max_filters, settings.time_limit_s)
    asked = F.struct(*[d(v).alias(n) for n, v in zip(acceptance.SETTINGS, values, strict=True)])
    level = F.struct(F.lit(normalization.mode).alias("mode"), d(normalization.frequency_hz).alias("frequencyHz"), d(normalization.level_db).alias("levelDb"))
    ended = F.when(F.col("termination") == "evaluation-limit", "time-limit").otherwise(F.col("termination"))
    marker = F.struct(F.lit(acceptance.STRUCTURAL[0]).alias("preset"), F.lit(acceptance.STRUCTURAL[1]).alias("seedMode"))
    met = (F.col("rmse") <= 0.25) & (F.col("max_abs") <= 0.75)
    manifest = F.struct(
        F.lit(3).alias("schemaVersion"), F.lit("standard-v2").alias("algorithmVersion"), d(SAMPLE_RATE_HZ).alias("sampleRateHz"), asked.alias("autoeqSettings"), level.alias("normalization"), own.alias("finalFilters"), measured.alias("metrics"),
        F.col("preamp_db").alias("preampDb"), met.alias("targetAchieved"), ended.alias("terminationReason"), marker.alias("experimental"),
    )
    return got.select(key, own.alias("filters"), measured.alias("metrics"), F.col("preamp_db").alias("preampDb"), manifest.alias("manifest"))


def recomputed(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Metrics of each run (CASE_KEYS, mae, rmse, max_abs, max_abs_hz) from its delivered filters and its case alone."""
    spark = runs.sparkSession
    keyed = runs.select(F.xxhash64(*CASE_KEYS).alias("preset_id"), *CASE_KEYS, "filters")
    wished = keyed.select("preset_id", F.posexplode("filters").alias("ordinal", "x")).select("preset_id", "ordinal", F.lit(True).alias("enabled"), "x.*")
    eq = filters.cascade(wished, grids.grid_frame(spark, grids.evaluation_grid())).select("preset_id", "idx", F.col("db").alias("eq"))
    case = cases.withColumn("case_id", F.col("case_id").cast("string"))
    met = keyed.drop("filters").join(case, "case_id").join(eq, ["preset_id", "idx"], "left")
    return metrics.error_metrics(met.withColumn("db", F.col("db") - F.coalesce("eq", F.lit(0.0))), CASE_KEYS)


def faults(runs: DataFrame, solvable: DataFrame | None = None) -> DataFrame:
    """case_id, budget_s, max_filters, fault of what a plan must not show: sets above the cap, solvable cases (case_id) that miss the target, repeats that differ,
    and longer budgets that are worse."""
    cell = CASE_KEYS[:3]
    out = runs.where(F.size("filters") > F.col("max_filters")).select(*cell, F.lit("above the cap").alias("fault"))
    if solvable is not None:
        missed = runs.where("NOT achieved").join(small_side(solvable.select(F.col("case_id").cast("string").alias("case_id")).distinct()), "case_id", "left_semi")
        out = out.unionByName(missed.select(*cell, F.lit("a solvable case misses the target").alias("fault")))
    same = F.to_json(F.struct("filters", "rmse", "max_abs", "termination"))
    out = out.unionByName(runs.groupBy(*cell).agg(F.count_distinct(same).alias("n")).where("n > 1").select(*cell, F.lit("repeats differ").alias("fault")))
    best = runs.groupBy(*cell).agg(F.min(metrics.violation(F.col("rmse"), F.col("max_abs"))).alias("v"))
    longer = best.select("case_id", "max_filters", F.col("budget_s").alias("_longer"), F.col("v").alias("_v"))
    worse = best.join(longer, ["case_id", "max_filters"]).where("_longer > budget_s AND _v > v + 1e-9 AND v > 1")
    return out.unionByName(worse.select("case_id", F.col("_longer").alias("budget_s"), "max_filters", F.lit("a longer budget is worse").alias("fault"))).distinct()


def execute(cases: DataFrame, cells: DataFrame, repeats: int = 1, engine: str = "v2", path: str | None = None, baseline: DataFrame | None = None, metadata: dict | None = None) -> dict[str, DataFrame]:
    """A whole plan: runs with verified metrics, aggregates, timelines, deltas, warnings; written under ``path`` if one is given."""
    runs = materialize(run_plan(cases, cells, repeats, engine), "research-runs")
    verified = acceptance.strict_metrics(runs.select(*CASE_KEYS, "mae", "rmse", "max_abs", "max_abs_hz"), recomputed(runs, cases), CASE_KEYS)
    verified.write.format("noop").mode("overwrite").save()  # raises on drift
    cell = F.concat_ws("|", *CASE_KEYS)
    points = runs.select(cell.alias("cell"), F.explode("checkpoints").alias("c")).select("cell", "c.*")
    quality = research.time_to_quality(points)
    out = {"runs": runs, "timeline": research.timeline(points), "quality": quality}
    timed = runs.withColumn("cell", cell).join(quality.select("cell", "joint_ms"), "cell", "left")
    out["aggregates"] = research.aggregate_runs(timed).join(research.termination_counts(runs), research.RUN_KEYS)
    out["warnings"] = research.monotonicity_warnings(out["aggregates"])
    if baseline is not None:
        out["deltas"] = research.compare(out["aggregates"], baseline, ["rmse_median", "max_abs_median", "achieved_rate", "joint_median_ms", "elapsed_median"])
    if path is not None:
        report.write(path, out["aggregates"], out.get("deltas"), out["warnings"], runs=runs, timeline=out["timeline"], metadata=metadata)
    return out


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """A committed baseline (JSON), or None where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.json(path, multiLine=True)
