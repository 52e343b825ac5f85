"""Mixing sources to target weights by iterative proportional fitting.

Token counts (words) are summed into cells of source, language and topic. Cell weights start at their tokens and are
raked in turn to the source, language and topic marginals, until a sweep changes no weight by more than ``TOLERANCE`` of it (``MAX_SWEEPS`` at most). Then the ratio of a
cell's weight to its tokens is the odds with which its documents are wanted. Ratios are scaled so that the largest is 1, and each
document stays if a hash of its doc_id falls below its cell's probability: a Bernoulli sample that is the same in every run.

Default targets: each source in proportion to the power ``SOURCE_POWER`` of its tokens, each language likewise with
``LANG_POWER``, topics as they are: the topic marginal only keeps raking from moving topics. Targets that contradict each other (a source and a language that are one cell) cannot all be
met; a marginal further than ``MARGINAL_GAP`` from its target at the end gives a warning that states the distance.

Only cells (distinct source, language, topic) are windowed; documents are pre-aggregated, so a source with a third of
all rows is a few cells. Topics come from a column expression; the default sorts texts by form.

Edge cases: null source, language or topic is a value of its own; a null or empty text has no tokens and its
cell counts none (probability 1 where a cell has no tokens); a null doc_id hashes as an empty
string; repeated rows are decided alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side
from .quality_rules import word_array

MAX_SWEEPS, TOLERANCE = 60, 1e-11
SOURCE_POWER = 0.85
LANG_POWER = 0.90
MARGINAL_GAP = 1e-3
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")


def topic_by_form(text: Column) -> Column:
    """A topic of each text by its form: code-like, list, dialogue, numbers, long or short prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike(r"[{};]\s*\n|</\w+>"), "markup")
        .when(t.rlike(r"\n\s*[-*•]\s"), "list")
        .when(t.rlike(r"\w@\w|https?://"), "contact")
        .when(t.rlike(r"\?"), "questions")
        .when(F.char_length(t) > 2500, "long prose")
        .otherwise("short prose")
    )


def _features(docs: DataFrame, topic: Column) -> dict[str, Column]:
    return {"_eq_tokens": F.size(word_array(F.col("text"))).cast("long"), "_eq_source": F.col("source").cast("string"), "_eq_lang": F.col("lang").cast("string"), "_eq_topic": topic}


def marginal_gap(raked: DataFrame) -> float:
    """The largest relative distance of a marginal of w from its target; 0 without targets."""
    gaps = []
    for d in DIMENSIONS:
        sums = raked.groupBy(d).agg(F.sum("w").alias("w"), F.first(f"target_{d}").alias("t")).where("t > 0")
        gaps.append(sums.agg(F.max(F.abs(F.col("w") / F.col("t") - 1))).first()[0])
    return max(g or 0.0 for g in gaps)


def rake(cells: DataFrame, sweeps: int = MAX_SWEEPS, source_power: float = SOURCE_POWER, lang_power: float = LANG_POWER) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with p, the probability of each cell's documents."""
    w = {d: Window.partitionBy(d) for d in DIMENSIONS}
    everything = cells.agg(F.sum("tokens").alias("total"))
    power = {"source": source_power, "lang": lang_power, "topic": 1.0}
    out = cells
    for d in DIMENSIONS:
        one = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power[d])).alias("m"))
        share = one.crossJoin(F.broadcast(one.agg(F.sum("m").alias("all_m")))).crossJoin(F.broadcast(everything))  # one row each
        marginal = share.select(F.col(d).alias("key_"), F.try_divide(F.col("m") * F.col("total"), "all_m").alias(f"target_{d}"))
        out = out.join(marginal, out[d].eqNullSafe(marginal["key_"])).drop("key_")
    out = materialize(out.withColumn("w", F.col("tokens").cast("double")), "mix-cells")
    done = 0
    while done < sweeps:
        for _ in range(min(2, sweeps - done)):
            out = out.withColumn("_before", F.col("w"))
            for d in DIMENSIONS:
                out = out.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"target_{d}"), F.sum("w").over(w[d])), F.lit(0.0)))
            done += 1
        out = materialize(out, "mix-sweep")
        if out.where(F.abs(F.col("w") - F.col("_before")) > TOLERANCE * F.col("_before")).isEmpty():
            break
    out = out.drop("_before")
    if (gap := marginal_gap(out)) > MARGINAL_GAP:
        warnings.warn(f"a raked marginal is {gap:.3g} of its target away from it after {done} sweeps", stacklevel=2)
    ratio = F.try_divide(F.col("w"), F.col("tokens").cast("double"))
    top = out.agg(F.max(ratio).alias("top"))
    return out.crossJoin(F.broadcast(top)).withColumn("p", F.coalesce(F.try_divide(ratio, "top"), F.lit(1.0)))


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _with_probability(seen: DataFrame, source: DataFrame) -> DataFrame:
    """``seen`` with _mix_p of its cell; ``source`` has the features of all rows and gives the cells."""
    cells = source.groupBy(F.col("_eq_source").alias("source"), F.col("_eq_lang").alias("lang"), F.col("_eq_topic").alias("topic")).agg(F.sum("_eq_tokens").alias("tokens"))
    cells = materialize(cells, "mix-counts")
    n = cells.count()
    p = rake(cells).select(F.struct("source", "lang", "topic").alias("_cell"), F.col("p").alias("_mix_p"))
    return seen.join(small_side(p, n), F.struct(F.col("_eq_source").alias("source"), F.col("_eq_lang").alias("lang"), F.col("_eq_topic").alias("topic")).eqNullSafe(F.col("_cell")), "left")


def mix(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, source, lang and any others) and _mix_tokens, _mix_topic, _mix_p, _mix_kept for each row."""
    topic = topic_by_form(F.col("text")) if topic is None else topic
    seen = docs.withColumns(_features(docs, topic))
    out = _with_probability(seen, seen)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, F.col("_eq_tokens").alias("_mix_tokens"), F.col("_eq_topic").alias("_mix_topic"), "_mix_p", (chance(F.col("doc_id")) < F.col("_mix_p")).alias("_mix_kept"))


def decisions(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, topic, probability, kept of each row: texts are read once, and only their features are kept."""
    topic = topic_by_form(F.col("text")) if topic is None else topic
    features = _features(docs, topic)
    seen = materialize(docs.withColumns(features).select("doc_id", *features), "mix-features")
    out = _with_probability(seen, seen)
    return out.select("doc_id", F.col("_eq_tokens").alias("n_tokens"), F.col("_eq_topic").alias("topic"), F.round("_mix_p", 6).alias("probability"), (chance(F.col("doc_id")) < F.col("_mix_p")).alias("kept"))


def keep_mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the sample takes."""
    return mix(docs).where("_mix_kept").drop("_mix_tokens", "_mix_topic", "_mix_p", "_mix_kept")
