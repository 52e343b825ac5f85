"""Order-sensitive features of residuals (key, idx, f, db): regions, extrema, boundaries, shelf evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import keep_apart
from ..schema import MAX_GAIN_DB, MAX_HZ, MAX_Q, MIN_HZ, MIN_Q, SHELF_Q
from .curves import interpolate_asof
from .scans import neighbours
from .sides import small_side


def residual_regions(residuals: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """key, start_idx, end_idx, start_hz, end_hz, sign, octaves of maximal runs of one sign at or above the threshold."""
    w = Window.partitionBy(key).orderBy("idx")
    sign = F.when(F.abs("db") >= threshold, F.when(F.col("db") < 0, -1).otherwise(1)).otherwise(0)
    rows = residuals.withColumn("sign", sign)
    rows = rows.withColumn("_edge", (F.col("sign") != F.coalesce(F.lag("sign").over(w), F.lit(0))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_edge").over(w)).where("sign <> 0")
    out = rows.groupBy(key, "_run", "sign").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("f").alias("start_hz"), F.max("f").alias("end_hz"))
    return out.withColumn("octaves", F.log2(F.col("end_hz") / F.col("start_hz"))).drop("_run")


def extrema(residuals: DataFrame, key: str, floor: float = 0.15, most: int | None = None) -> DataFrame:
    """key, idx, f, db of interior local extremes at or above the floor. With ``most``, residuals of more places are spread over tasks."""
    rows = neighbours(residuals, [key], ["idx"], F.col("db"), 1, 1, most).withColumnsRenamed({"_before1": "_p", "_after1": "_n"}).where("_p IS NOT NULL AND _n IS NOT NULL")
    up, down = (F.col("db") > 0) & (F.col("db") >= F.col("_p")) & (F.col("db") > F.col("_n")), (F.col("db") < 0) & (F.col("db") <= F.col("_p")) & (F.col("db") < F.col("_n"))
    return rows.where((F.abs("db") >= floor) & (up | down)).select(key, "idx", "f", "db")


def boundaries(residuals: DataFrame, key: str, floor: float = 0.15) -> DataFrame:
    """Each extreme with the nearest place to its left and right where the sign changes or the level is zero (else the edge), and where
    it first falls to half its height (else that boundary).

    Sign boundaries are running windows; half heights look only within an extreme's own run of one sign.
    """
    w = Window.partitionBy(key).orderBy("idx")
    sign = F.signum("db")
    rows = residuals.withColumn("_s", sign)
    rows = rows.withColumns({"_new": F.coalesce(F.lag("_s").over(w) != F.col("_s"), F.lit(False)).cast("int"), "_first": F.min("idx").over(Window.partitionBy(key)), "_last": F.max("idx").over(Window.partitionBy(key))})
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    run = Window.partitionBy(key, "_run")
    rows = rows.withColumns({"_a": F.min("idx").over(run), "_b": F.max("idx").over(run)})
    tops = extrema(residuals, key, floor).select(key, F.col("idx").alias("at"), F.col("db").alias("top"))
    own = rows.select(key, "_run", "_a", "_b", "_first", "_last", F.col("idx").alias("at")).join(tops, [key, "at"])
    near = own.join(rows.select(key, "_run", "idx", "db"), [key, "_run"])
    half = F.abs("db") <= F.abs("top") / 2
    found = near.groupBy(key, "at", "top").agg(
        F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.first("_first").alias("_first"), F.first("_last").alias("_last"), F.max(F.when(half & (F.col("idx") < F.col("at")), F.col("idx"))).alias("_hl"), F.min(F.when(half & (F.col("idx") > F.col("at")), F.col("idx"))).alias("_hr")
    )
    # a run that reaches the edge has no crossing there: its half height, if it has one, is the boundary in either mode
    left = F.when(F.col("_a") > F.col("_first"), F.col("_a") - 1).otherwise(F.coalesce("_hl", "_first"))
    right = F.when(F.col("_b") < F.col("_last"), F.col("_b") + 1).otherwise(F.coalesce("_hr", "_last"))
    return found.select(key, F.col("at").alias("idx"), F.col("top").alias("db"), left.alias("left_idx"), right.alias("right_idx"), F.coalesce("_hl", left).alias("half_left_idx"), F.coalesce("_hr", right).alias("half_right_idx"))


def strongest_feature(residuals: DataFrame, key: str) -> DataFrame:
    """key, f, db of the largest local maximum of |residual| (ends may be it), the first on ties."""
    w = Window.partitionBy(key).orderBy("idx")
    a = F.abs("db")
    rows = residuals.withColumns({"_p": F.lag(a).over(w), "_n": F.lead(a).over(w)})
    tops = rows.where((a >= F.coalesce("_p", F.lit(0.0))) & (a >= F.coalesce("_n", F.lit(0.0))))
    best = tops.groupBy(key).agg(F.max(F.struct(a.alias("a"), (-F.col("idx")).alias("i"), F.col("f").alias("f"), F.col("db").alias("db"))).alias("b"))
    return best.select(key, F.col("b.f").alias("f"), F.col("b.db").alias("db"))


def shelf_evidence(residuals: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """key, type, gain, octaves of shelves: 70 % of one sign and a median |residual| of the threshold at least."""
    shelves = F.array(*[F.when(F.col("f").between(lo, hi), F.lit(t)) for t, lo, hi in (("LS", 20.0, 200.0), ("HS", 8000.0, 20_000.0))])
    rows = residuals.withColumn("type", F.explode(F.filter(shelves, lambda t: t.isNotNull())))
    agg = rows.groupBy(key, "type").agg(F.count_if(F.col("db") > 0).alias("up"), F.count_if(F.col("db") < 0).alias("down"), F.count(F.lit(1)).alias("n"), F.median("db").alias("gain"), F.median(F.abs("db")).alias("size"), F.log2(F.max("f") / F.min("f")).alias("octaves"))
    return agg.where((F.greatest("up", "down") / F.col("n") >= 0.7) & (F.col("size") >= threshold)).select(key, "type", F.least(F.lit(15.0), F.greatest(F.lit(-15.0), F.col("gain"))).alias("gain"), "octaves")


def cheap_score(residuals: DataFrame, responses: DataFrame, key: str, candidate: str) -> DataFrame:
    """key, candidate, score: how much squared residual each candidate's response takes away.

    ``responses`` (key, candidate, idx, r) has candidates of each key, or, without key, candidates that all keys share.
    """
    on = [key, "idx"] if key in responses.columns else ["idx"]
    met = residuals.select(key, "idx", "db").join(responses if len(on) > 1 else small_side(responses), on)
    return met.groupBy(key, candidate).agg(F.sum(F.col("db") * F.col("db") - (F.col("db") - F.col("r")) * (F.col("db") - F.col("r"))).alias("score"))


def separated_peaks(residuals: DataFrame, key: str, most: int, separation: float, floor: float = 0.15, ends: bool = True) -> DataFrame:
    """key, place (from 1), f, db of up to ``most`` peaks of |residual|, the highest first, each at least ``separation`` octaves from those before it.

    A peak is a place of ``floor`` or more whose |residual| is not below either neighbour's; the curve's ends may be peaks. A curve's peaks are gathered in its row.
    """
    w = Window.partitionBy(key).orderBy("idx")
    a = F.abs("db")
    rows = residuals.withColumns({"_p": F.lag(a).over(w), "_n": F.lead(a).over(w)})
    tops = rows.where((a >= floor) & (a >= F.coalesce("_p", F.lit(0.0))) & (a >= F.coalesce("_n", F.lit(0.0))))
    if not ends:
        tops = tops.where("_p IS NOT NULL AND _n IS NOT NULL")
    ranked = F.array_sort(F.collect_list(F.struct((-a).alias("rank"), "idx", "f", "db")))
    near = lambda k, x: F.abs(F.log2(x["f"] / k["f"])) < separation
    kept = tops.groupBy(key).agg(ranked.alias("r")).select(key, F.posexplode(keep_apart(F.col("r"), near, most)).alias("at", "x"))
    return kept.select(key, (F.col("at") + 1).alias("place"), F.col("x.f").alias("f"), F.col("x.db").alias("db"))


def candidates(residuals: DataFrame, key: str, threshold: float = 0.5, tolerance: float = 1 / 48) -> DataFrame:
    """key, place (from 1), type, f, gain, q, octaves: first-generation candidates of a residual, the widest first, without near-repeats of a type.

    Each region of one sign is a peak at its geometric centre, with the level there; the ends may speak for shelves. One that lies within ``tolerance`` octaves of a kept
    one of its type goes.
    """
    clamp = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    runs = residual_regions(residuals, key, threshold).withColumn("f", clamp(F.sqrt(F.col("start_hz") * F.col("end_hz")), MIN_HZ, MAX_HZ))
    level = interpolate_asof(residuals.select(key, "f", "db"), runs.select(key, "f").distinct(), key)
    wide = F.greatest(F.col("end_hz") - F.col("start_hz"), F.lit(1e-9))
    peaks = runs.join(level, [key, "f"]).select(key, F.lit("PK").alias("type"), "f", clamp(F.col("db"), -MAX_GAIN_DB, MAX_GAIN_DB).alias("gain"), clamp(F.col("f") / wide, MIN_Q, MAX_Q).alias("q"), "octaves")
    nominal = F.when(F.col("type") == "LS", F.lit(105.0)).otherwise(F.lit(10_000.0))
    shelves = shelf_evidence(residuals, key, threshold).select(key, "type", nominal.alias("f"), "gain", F.lit(SHELF_Q).alias("q"), "octaves")
    per = peaks.unionByName(shelves).groupBy(key).agg(F.collect_list(F.struct("type", "f", "gain", "q", "octaves")).alias("items"))
    return kept_candidates(per, key, tolerance)


def kept_candidates(found: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, place (from 1), type, f, gain, q, octaves of ``found`` (key, items: an array of those): the widest first, without those within ``tolerance`` octaves of a kept one of their type."""
    order = lambda x: F.when(x["type"] == "LS", 0).when(x["type"] == "PK", 1).otherwise(2)
    # widths of as many places are equal but for their last bits, which do not decide
    item = lambda x: F.struct((-F.round(x["octaves"], 9)).alias("k0"), (-F.round(F.abs(x["gain"]), 9)).alias("k1"), x["f"].alias("k2"), order(x).alias("k3"), *[x[c].alias(c) for c in ("type", "f", "gain", "q", "octaves")])
    near = lambda k, x: (k["type"] == x["type"]) & (F.abs(F.log2(k["f"] / x["f"])) <= tolerance)
    per = found.select(key, F.array_sort(F.transform("items", item)).alias("r"))
    kept = per.select(key, F.posexplode(keep_apart(F.col("r"), near)).alias("at", "x"))
    return kept.select(key, (F.col("at") + 1).alias("place"), "x.type", "x.f", "x.gain", "x.q", "x.octaves")
