"""Orders, top-k, Pareto fronts and de-duplication of solutions and candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import distance, target_achieved, violation

EPS = 1e-12
#: Parts of a group in which skylines meet first.
SPREAD = 64


def primary_key() -> Column:
    """violation, rmse, max_abs."""
    return F.struct(violation(F.col("rmse"), F.col("max_abs")).alias("violation"), F.col("rmse"), F.col("max_abs"))


def solution_order() -> list[Column]:
    """All of a solution's rank, best first: metrics, cancellation, largest Q and gain, total gain, count."""
    return [violation(F.col("rmse"), F.col("max_abs")), F.col("rmse"), F.col("max_abs"), F.col("cancellation"), F.col("max_q"), F.col("max_gain"), F.col("sum_gain"), F.col("n")]


def filter_order(solutions: DataFrame) -> list[Column]:
    """What decides among equal metrics, if ``solutions`` have ``filters``: filter by filter, frequency, type, gain and Q."""
    if "filters" not in solutions.columns:
        return []
    kind = lambda x: F.when(x["type"] == "LS", 0).when(x["type"] == "PK", 1).otherwise(2)
    return [F.transform("filters", lambda x: F.struct(x["f"].alias("f"), kind(x).alias("type"), x["gain"].alias("gain"), x["q"].alias("q")))]


def rank_solutions(solutions: DataFrame, group: str, last: str) -> DataFrame:
    """``solutions`` with rank within ``group``: by metrics, then filter by filter, then by ``last``."""
    w = Window.partitionBy(group).orderBy(*solution_order(), *filter_order(solutions), last)
    return solutions.withColumn("rank", F.row_number().over(w))


def rank_deliverable(solutions: DataFrame, group: str, last: str, places: int = 9) -> DataFrame:
    """Those that meet the target first, then by normalized distance (to ``places`` digits, so that engines agree on ties), then as solutions."""
    met, far = target_achieved(F.col("rmse"), F.col("max_abs")), F.round(distance(F.col("rmse"), F.col("max_abs")), places)
    w = Window.partitionBy(group).orderBy(met.desc(), far, *solution_order(), *filter_order(solutions), last)
    return solutions.withColumn("rank", F.row_number().over(w))


def shortlist(candidates: DataFrame, group: str, limit: int = 8) -> DataFrame:
    """The best candidate of each (feature, mode) first, then the rest, ``limit`` in all."""
    order = [F.col("score").desc(), F.col("f"), F.when(F.col("type") == "LS", 0).when(F.col("type") == "PK", 1).otherwise(2), F.col("gain"), F.col("q"), F.col("ordinal")]
    best = F.row_number().over(Window.partitionBy(group, "feature", "mode").orderBy(*order)) == 1
    ranked = candidates.withColumn("representative", best)
    w = Window.partitionBy(group).orderBy(F.col("representative").desc(), *order)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def retained_paths(paths: DataFrame, group: str, last: str, cap: int = 3, ratio: float = 1.02) -> DataFrame:
    """Paths within ``ratio`` of the best violation; one more while ``stagnant`` and fewer than ``cap`` are left; ``cap`` in all."""
    v = violation(F.col("rmse"), F.col("max_abs"))
    w = Window.partitionBy(group).orderBy(v, "rmse", "max_abs", last)
    whole = Window.partitionBy(group)
    out = paths.withColumns({"violation": v, "rank": F.row_number().over(w), "_best": F.min(v).over(whole)}).withColumn("_near", F.col("violation") <= F.col("_best") * ratio)
    out = out.withColumn("_n", F.sum(F.col("_near").cast("int")).over(whole))
    escape = F.col("stagnant") & (F.col("_n") < cap) & (F.col("rank") == F.col("_n") + 1)
    return out.where((F.col("_near") | escape) & (F.col("rank") <= cap)).drop("_best", "_near", "_n")


def _skyline(values: np.ndarray) -> np.ndarray:
    """Which rows (n, metrics) no other row dominates: no worse in all and better in one, beyond ``EPS``."""
    order = np.lexsort(values.T[::-1])
    kept: list[int] = []
    front = np.empty((0, values.shape[1]))
    for i in order:  # whoever dominates a row is before it in this order, but for ties within the tolerance
        x = values[i]
        if not ((front <= x + EPS).all(axis=1) & (front < x - EPS).any(axis=1)).any():
            beaten = (x <= front + EPS).all(axis=1) & (x < front - EPS).any(axis=1)
            kept = [k for k, gone in zip(kept, beaten, strict=True) if not gone] + [int(i)]
            front = values[kept]
    out = np.zeros(len(values), bool)
    out[kept] = True
    return out


def _front_rows(group: str, names: list[str]):
    """Rows of each group in whatever comes, less those that another of them dominates. Memory: the rows kept and a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(group, dropna=False, sort=False):
                key = None if pd.isna(key) else key
                both = pd.concat([held[key], part]) if key in held else part
                held[key] = both[_skyline(both[names].to_numpy(np.float64))]
        yield from held.values()

    return run


def pareto_front(states: DataFrame, group: str, metrics: tuple[str, ...] = ("n", "rmse", "max_abs", "cancellation")) -> DataFrame:
    """States that no other of their group dominates: no worse in all metrics and better in one, beyond a tiny tolerance (equals stay, all of them).

    Each partition first leaves its own skyline, wherever its rows lie; these meet in ``SPREAD`` parts of each group, and only what is left there meets by
    group. A hot group is thus reduced twice before one task sees it. Null groups are a group; metrics are not null.
    """
    names, keep = list(metrics), _front_rows(group, list(metrics))
    local = states.mapInPandas(keep, states.schema)
    spread = local.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(SPREAD))).repartition(F.col(group), F.col("_part")).drop("_part")
    return spread.mapInPandas(keep, states.schema).repartition(group).mapInPandas(keep, states.schema)


def retain_beam(states: DataFrame, group: str, width: int) -> DataFrame:
    """The states of each group that none dominates in rmse and largest deviation, the first ``width`` by the reference key."""
    w = Window.partitionBy(group).orderBy(reference_key())
    return pareto_front(states, group, ("rmse", "max_abs")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= width).drop("_n")


def reference_key() -> Column:
    """The order of reference points: those that meet the target by count, others by violation."""
    met = target_achieved(F.col("rmse"), F.col("max_abs"))
    v = violation(F.col("rmse"), F.col("max_abs"))
    first, second, third, fourth = (F.when(met, a.cast("double")).otherwise(b.cast("double")) for a, b in ((F.lit(0), F.lit(1)), (F.col("n"), v), (F.col("rmse"), F.col("rmse")), (F.col("max_abs"), F.col("max_abs"))))
    return F.struct(first.alias("k0"), second.alias("k1"), third.alias("k2"), fourth.alias("k3"), F.col("cancellation").cast("double").alias("k4"), F.when(met, F.lit(0.0)).otherwise(F.col("n").cast("double")).alias("k5"), F.col("id").alias("k6"))


def reference_point(states: DataFrame, group: str) -> DataFrame:
    return states.groupBy(group).agg(F.min(F.struct(reference_key().alias("k"), F.struct("id", "n", "rmse", "max_abs", "cancellation").alias("s"))).alias("b")).select(group, "b.s.*")


#: The root collation: letters before case, digits before letters, marks before both.
COLLATION = "UNICODE"


def by_name(*names: str) -> list[Column]:
    """An order of texts as people read them, and by their bytes where the collation sees no difference."""
    return [c for n in names for c in (F.collate(F.col(n), COLLATION), F.col(n))]


def ordered(proposals: DataFrame, group: str) -> DataFrame:
    """``proposals`` with place (from 1) by mutation and key."""
    return proposals.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*by_name("mutation", "key"))))


def quota(proposals: DataFrame, group: str, lexical: int = 6, best: int = 2, total: int = 8) -> DataFrame:
    """``lexical`` first by name, then the ``best`` by rmse with other keys, then filled by name and by rmse up to ``total``."""
    named_order = Window.partitionBy(group).orderBy(*by_name("mutation", "key"))
    unique = proposals.withColumn("_u", F.row_number().over(Window.partitionBy(group, "key").orderBy(*by_name("mutation")))).where("_u = 1").drop("_u")
    named = unique.withColumn("_name", F.row_number().over(named_order)).withColumn("_first", F.col("_name") <= lexical)
    rest = Window.partitionBy(group, "_first").orderBy("rmse", *by_name("mutation", "key"))
    chosen = named.withColumn("_second", ~F.col("_first") & (F.row_number().over(rest) <= best))
    stage = F.when(F.col("_first"), 0).when(F.col("_second"), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(group).orderBy(stage, F.when(F.col("_second"), F.col("rmse")), "_name"))
    return chosen.withColumn("place", place).where(F.col("place") <= total).drop("_name", "_first", "_second")


def first_of_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Exact de-duplication: the first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unseen(proposals: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    """Proposals whose key has not been visited."""
    return proposals.join(seen.select(key).distinct(), key, "left_anti")


def gathered_key(name: str) -> Column:
    """What a filter set's key is made of, as an aggregate of its filters."""
    whole = lambda c, k: F.round(F.col(c) * k).cast("long")
    return F.collect_list(F.struct("type", whole("f", 1000).alias("f"), whole("gain", 10).alias("gain"), whole("q", 100).alias("q"), "enabled")).alias(name)


def key_of(name: str) -> Column:
    """The key of what ``gathered_key`` gathered."""
    line = F.transform(F.sort_array(name), lambda v: F.concat_ws("|", v["type"], v["f"].cast("string"), v["gain"].cast("string"), v["q"].cast("string"), v["enabled"].cast("string")))
    return F.sha2(F.concat_ws(";", line), 256)


def semantic_key(filters: DataFrame, group: str = "preset_id") -> DataFrame:
    """group, key: a hash of a filter set (64 at most) without ids and order; frequencies to 0.001 Hz, gains to 0.1 dB, Q to 0.01."""
    return filters.groupBy(group).agg(gathered_key("x")).select(group, key_of("x").alias("key"))
