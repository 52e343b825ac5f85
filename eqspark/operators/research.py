"""The relational layer over research runs and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TIMELINE_MARKS_MS
from ..storage import materialize
from .metrics import violation
from .scans import BLOCK_ROWS, least_before
from .sides import small_side

RUN_KEYS = ["case_id", "budget_s", "max_filters"]
#: (column, predicate over rmse and max_abs).
QUALITY = [
    *((f"rmse{round(100 * x):03d}_ms", f"rmse <= {x}e0") for x in (1.0, 0.75, 0.5, 0.35, 0.25)),
    *((f"maxabs{round(100 * x):03d}_ms", f"max_abs <= {x}e0") for x in (2.0, 1.5, 1.0, 0.75)),
    ("joint_ms", "rmse <= 0.25e0 AND max_abs <= 0.75e0"),
]


def _metric() -> Column:
    return F.struct(violation(F.col("rmse"), F.col("max_abs")).alias("v"), "rmse", "max_abs")


def _improving(checkpoints: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    out = least_before(checkpoints, keys, [order], _metric(), "_best", most).withColumn("_m", _metric())
    return out.where("_best IS NULL OR _m < _best").drop("_m", "_best")


def best_history(checkpoints: DataFrame, key: str = "cell", most: int = BLOCK_ROWS) -> DataFrame:
    """Checkpoints that strictly improve on all before, by (violation, rmse, max_abs). A cell of more than ``most`` is spread over blocks."""
    return _improving(checkpoints, [key], "elapsed_ms", most)


def timeline(checkpoints: DataFrame, key: str = "cell", marks: tuple[int, ...] = TIMELINE_MARKS_MS) -> DataFrame:
    """key, mark_ms, rmse, max_abs: the best checkpoint up to each mark; marks before the first checkpoint are absent.

    Every checkpoint first lands in the interval that ends at its next mark (a running minimum over the few intervals
    of a cell follows), so checkpoints are never multiplied by marks.
    """
    spark = checkpoints.sparkSession
    metric = F.struct(violation(F.col("rmse"), F.col("max_abs")).alias("v"), F.col("rmse"), F.col("max_abs"), F.col("elapsed_ms"))
    mark = F.lit(None).cast("int")
    for m in reversed(marks):
        mark = F.when(F.col("elapsed_ms") <= m, m).otherwise(mark)
    per = checkpoints.withColumn("mark_ms", mark).where("mark_ms IS NOT NULL").groupBy(key, "mark_ms").agg(F.min(metric).alias("m"))
    all_marks = per.select(key).distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in marks], "mark_ms int")))
    w = Window.partitionBy(key).orderBy("mark_ms").rowsBetween(Window.unboundedPreceding, 0)
    out = all_marks.join(per, [key, "mark_ms"], "left").withColumn("m", F.min("m").over(w)).where("m IS NOT NULL")
    return out.select(key, "mark_ms", "m.rmse", "m.max_abs")


def time_to_quality(checkpoints: DataFrame, key: str = "cell", most: int = BLOCK_ROWS) -> DataFrame:
    """The first time each threshold is met in the history of best checkpoints; null if never."""
    history = best_history(checkpoints, key, most)
    return history.groupBy(key).agg(*[F.min(F.when(F.expr(p), F.col("elapsed_ms"))).alias(n) for n, p in QUALITY])


#: Values of a group that one task may hold for an exact median; larger groups are narrowed first.
MEDIAN_ROWS = 100_000
BINS = 1024
NEVER = 1.7976931348623157e308


def medians(values: DataFrame, keys: list[str], most: int = MEDIAN_ROWS) -> DataFrame:
    """keys, n, least, median, most of the values v (double, not null) of each group, exactly.

    Each middle rank has bounds of its own. While there are more than ``most`` values between two of them, a histogram of ``BINS`` equal bins narrows them to
    the bin that holds the rank, so no task gathers a group of unbounded size; as the least and the greatest value fall into different bins, this ends.
    """
    whole = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    if (whole.agg(F.max("n")).first()[0] or 0) <= most:  # groups that a task can hold: the same medians at once
        return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.median("v").alias("median"), F.max("v").alias("most"))
    whole = materialize(whole, "median-groups")
    ranks = F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))))
    bounds = whole.select(*keys, ranks.alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    each = [*keys, "rank"]
    while (bounds.where("lo < hi").agg(F.max("inside")).first()[0] or 0) > most:
        # halves before the difference: bounds may be as far apart as doubles get
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        met = values.join(small_side(bounds), keys).where("lo < hi AND v BETWEEN lo AND hi")
        bins = met.groupBy(*each, "below", F.least(F.floor(share * (BINS - 1)), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*each).orderBy("bin"))  # a thousand bins a rank
        bins = bins.withColumn("before", F.col("below") + upto - F.col("c")).where((F.col("before") <= F.col("rank")) & (F.col("before") + F.col("c") > F.col("rank")))
        pick = lambda name, old: F.coalesce(name, old).alias(old)
        bounds = bounds.join(bins.select(*each, "a", "b", "before", "c"), each, "left").select(*each, pick("a", "lo"), pick("b", "hi"), pick("before", "below"), pick("c", "inside"))
        bounds = materialize(bounds, "median-bounds")
    open_ = bounds.where("lo < hi")
    held = values.join(small_side(open_.drop("below", "inside")), keys).where("v BETWEEN lo AND hi").groupBy(*each).agg(F.sort_array(F.collect_list("v")).alias("x"))
    middle = bounds.join(held, each, "left").withColumn("m", F.coalesce(F.get("x", (F.col("rank") - F.col("below")).cast("int")), F.col("lo")))
    middle = middle.groupBy(*keys).agg(F.min("m").alias("_p"), F.max("m").alias("_q"))
    median = F.when(F.col("_p") == F.col("_q"), F.col("_p")).otherwise(F.col("_p") / 2 + F.col("_q") / 2)
    return whole.join(middle, keys).select(*keys, "n", "least", median.alias("median"), "most")


def aggregate_runs(runs: DataFrame, most: int = MEDIAN_ROWS) -> DataFrame:
    """One row for each (case, budget, filters): counts, rate and summaries (best, median, worst, spread) of rmse, largest deviation and elapsed time.

    Median and worst time to both targets treat null as never; if that is what they come to, they are null.
    """
    metrics = ("rmse", "max_abs", "elapsed_ms", "joint_ms")
    value = lambda m: F.coalesce(F.col(m).cast("double"), F.lit(NEVER)) if m == "joint_ms" else F.col(m).cast("double")
    reached = lambda c: F.when(c < NEVER / 4, c)
    counts = [F.count(F.lit(1)).alias("run_count"), F.count_if("achieved").alias("achieved_count")]
    rate = F.col("achieved_count") / F.col("run_count")
    if (runs.groupBy(*RUN_KEYS).count().agg(F.max("count")).first()[0] or 0) <= most:  # groups that a task can hold: everything in one aggregate
        own = []
        for m, name in (("rmse", "rmse"), ("max_abs", "max_abs"), ("elapsed_ms", "elapsed")):
            v = value(m)
            own += [F.min(v).alias(f"{name}_best"), F.median(v).alias(f"{name}_median"), F.max(v).alias(f"{name}_worst"), (F.max(v) - F.min(v)).alias(f"{name}_spread")]
        own += [F.median(value("joint_ms")).alias("joint_median_ms"), F.max(value("joint_ms")).alias("joint_worst_ms")]
        out = runs.groupBy(*RUN_KEYS).agg(*counts, *own)
        return out.withColumns({"joint_median_ms": reached(F.col("joint_median_ms")), "joint_worst_ms": reached(F.col("joint_worst_ms")), "achieved_rate": rate})
    long = runs.select(*RUN_KEYS, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), value(m).alias("v")) for m in metrics])).alias("x")).select(*RUN_KEYS, "x.*")
    per = medians(long.where("v IS NOT NULL"), [*RUN_KEYS, "metric"], most)
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    columns = []
    for m, name in (("rmse", "rmse"), ("max_abs", "max_abs"), ("elapsed_ms", "elapsed")):
        columns += [of(m, "least").alias(f"{name}_best"), of(m, "median").alias(f"{name}_median"), of(m, "most").alias(f"{name}_worst"), (of(m, "most") - of(m, "least")).alias(f"{name}_spread")]
    columns += [reached(of("joint_ms", "median")).alias("joint_median_ms"), reached(of("joint_ms", "most")).alias("joint_worst_ms")]
    out = runs.groupBy(*RUN_KEYS).agg(*counts).join(per.groupBy(*RUN_KEYS).agg(*columns), RUN_KEYS)
    return out.withColumn("achieved_rate", rate)


def termination_counts(runs: DataFrame) -> DataFrame:
    """Reasons as a map for each group; only (group, reason) counts are gathered."""
    per = runs.groupBy(*RUN_KEYS, "termination").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*RUN_KEYS).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("termination", "n")))).alias("reasons"))


def percent(delta: Column, base: Column) -> Column:
    return F.when(base != 0, delta / base * 100)


def compare(candidate: DataFrame, baseline: DataFrame, values: list[str]) -> DataFrame:
    """Deltas and percents of cells that both have; nulls stay null."""
    b = baseline.select(*RUN_KEYS, *[F.col(v).alias(f"_{v}") for v in values])
    out = candidate.join(b, RUN_KEYS)
    cols = []
    for v in values:
        delta = F.col(v) - F.col(f"_{v}")
        cols += [delta.alias(f"{v}_delta"), percent(delta, F.col(f"_{v}")).alias(f"{v}_percent")]
    return out.select(*RUN_KEYS, *cols)


def monotonicity_warnings(aggregates: DataFrame, pairs: tuple[tuple[int, int], ...] = ((15, 30), (30, 60))) -> DataFrame:
    """Cells whose longer budget is practically worse than the shorter one."""
    longer = F.lit(None).cast("int")
    for a, b in pairs:
        longer = F.when(F.col("budget_s") == a, b).otherwise(longer)
    s = aggregates.select("case_id", "max_filters", F.col("budget_s").alias("shorter_s"), longer.alias("longer_s"), F.col("rmse_median").alias("rmse_a"), F.col("max_abs_median").alias("max_a"))
    l = aggregates.select("case_id", "max_filters", F.col("budget_s").alias("longer_s"), F.col("rmse_median").alias("rmse_b"), F.col("max_abs_median").alias("max_b"))
    out = s.join(l, ["case_id", "max_filters", "longer_s"]).withColumns({"rmse_delta": F.col("rmse_b") - F.col("rmse_a"), "max_abs_delta": F.col("max_b") - F.col("max_a")})
    return out.where("rmse_delta > 0.05e0 OR max_abs_delta > 0.10e0").select("case_id", "max_filters", "shorter_s", "longer_s", "rmse_delta", "max_abs_delta", (F.col("rmse_delta") > 0.05).alias("rmse_trigger"), (F.col("max_abs_delta") > 0.10).alias("max_abs_trigger"))


def research_cells(spark, cases: list[str], budgets: list[int], capacities: list[int], longest: bool = False, profile: tuple[str, int] | None = None, standard: int = 10) -> DataFrame:
    """The distinct cells of a plan (three short lists): case_id, budget_s, max_filters, mode.

    ``longest`` adds each case at 120 s, ``profile`` one (case, budget), both with ``standard`` filters; the profiled cell is run with deep telemetry.
    """
    c = spark.createDataFrame([(x,) for x in cases], "case_id string")
    b = spark.createDataFrame([(x,) for x in budgets], "budget_s int")
    m = spark.createDataFrame([(x,) for x in capacities], "max_filters int")
    out = c.crossJoin(b).crossJoin(m)
    extra = [(x, 120, standard) for x in cases if longest] + ([(*profile, standard)] if profile else [])
    if extra:
        out = out.unionByName(spark.createDataFrame(extra, out.schema))
    deep = F.lit(False) if profile is None else (F.col("case_id") == profile[0]) & (F.col("budget_s") == profile[1]) & (F.col("max_filters") == standard)
    return out.dropDuplicates().withColumn("mode", F.when(deep, "deep").otherwise("light"))


def telemetry(events: DataFrame, keys: list[str], peaks: tuple[str, ...] = ("peak_working_filters",)) -> DataFrame:
    """keys, counters (a map) of telemetry events (keys, name, n): sums, and the largest n of those in ``peaks``."""
    per = events.groupBy(*keys, "name").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    value = F.when(F.col("name").isin(*peaks), F.greatest(F.col("top"), F.lit(0))).otherwise(F.col("total"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", value.cast("long").alias("n"))))).alias("counters"))


def improving_checkpoints(checkpoints: DataFrame, keys: list[str], most: int = BLOCK_ROWS) -> DataFrame:
    """Checkpoints (keys, seq, elapsed_ms, rmse, max_abs) that are better than the last one kept: as each kept one is the best so far, those better than all before."""
    return _improving(checkpoints, keys, "seq", most).withColumn("elapsed_ms", F.greatest(F.col("elapsed_ms"), F.lit(0)))
