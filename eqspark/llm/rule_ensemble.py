"""Quality classifier: a sparse ensemble of conjunctive rules.

Statistics of each whole text are column expressions. Small boosted trees over the statistics of a bounded labelled sample give
candidate rules: every path from a root to a node is a conjunction of comparisons. A lasso-penalised logistic regression (proximal
gradient) weights the rules and sets most to zero, and the rest compile into one column expression: the score is
the logistic of the sum of the weights of the rules that hold.

Labels are learned from at most ``TRAIN_ROWS`` labelled documents, those with the smallest id hashes, never from those with
crc32(doc_id) mod 4 = 2. Of rows that share a doc_id one is learned from.

Edge cases: a null or empty text has all statistics zero and is scored by the rules that then hold; without labels the
score is 0.5, with one class only it is that class's share, smoothed; repeated rows are scored each; a doc_id with
several labels counts as each of them; null labels are not learned from; a null doc_id is scored; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, labelled, materialize
from .quality_rules import word_array

HELD_OUT_MOD, HELD_OUT_REST = 4, 2
TRAIN_ROWS = 12_000
THRESHOLD = 0.7
TREES, DEPTH, RATE = 24, 3, 0.3
BINS = 64
LASSO = 0.002
STEPS = 600

STATISTICS = ("n_words", "word_length", "symbols", "capitals", "bangs", "digits", "marks", "distinct", "lines", "line_repeats", "short_lines")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics (doubles, rounded so that every engine compares alike) of each row."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"))
    rows = rows.withColumns({"w": word_array(F.col("t")), "l": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    t = F.col("t")
    without = lambda pattern: F.char_length(F.regexp_replace(t, pattern, ""))
    rows = rows.select(
        "doc_id",
        F.size("w").alias("n"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.char_length(t).alias("chars"),
        without(SPACE_CLASS).alias("word_chars"),
        without(r"[#*$%&|<>]+").alias("no_symbols"),
        without(r"\p{Lu}+").alias("no_capitals"),
        without(r"!+").alias("no_bangs"),
        without(r"[0-9]+").alias("no_digits"),
        without(r"[.,;:?]+").alias("no_marks"),
        F.size("l").alias("n_lines"),
        F.size(F.array_distinct("l")).alias("n_lines_distinct"),
        F.size(F.filter("l", lambda x: F.char_length(x) < 20)).alias("n_short"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    c = F.col
    of_chars = lambda name: share(c("chars") - c(name), c("chars"))
    return rows.select(
        "doc_id",
        c("n").cast("double").alias("n_words"),
        share(c("word_chars"), c("n")).alias("word_length"),
        of_chars("no_symbols").alias("symbols"),
        of_chars("no_capitals").alias("capitals"),
        of_chars("no_bangs").alias("bangs"),
        of_chars("no_digits").alias("digits"),
        of_chars("no_marks").alias("marks"),
        share(c("n_distinct"), c("n")).alias("distinct"),
        share(c("n_lines"), c("n")).alias("lines"),
        share(c("n_lines") - c("n_lines_distinct"), c("n_lines")).alias("line_repeats"),
        share(c("n_short"), c("n_lines")).alias("short_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_above, limit): above means > limit, else <= limit."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[s] > v) if above else (x[s] <= v) for s, above, v in self.terms])

    def column(self) -> Column:
        out = None
        for s, above, v in self.terms:
            term = F.col(s) > v if above else F.col(s) <= v
            out = term if out is None else out & term
        return out


def _simplify(terms: list[tuple[str, bool, float]]) -> Rule:
    """One lower and one upper limit for each statistic, in a fixed order."""
    tightest: dict[tuple[str, bool], float] = {}
    for s, above, v in terms:
        old = tightest.get((s, above))
        tightest[s, above] = v if old is None else max(old, v) if above else min(old, v)
    return Rule(tuple(sorted((s, above, v) for (s, above), v in tightest.items())))


def grow_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """Paths of gradient-boosted trees over binned statistics; each tree sees half of the rows."""
    rng = np.random.default_rng(seed)
    names = list(x)
    cuts = [np.unique(np.quantile(x[s], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for s in names]
    bins = np.stack([np.searchsorted(c, x[s], side="left") for s, c in zip(names, cuts, strict=True)], axis=1)  # bin <= b means value <= cut b
    score = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        rows = rng.permutation(len(y))[: max(1, len(y) // 2)]
        step = np.zeros(len(y))

        def split(inside: np.ndarray, everyone: np.ndarray, terms: list, level: int) -> None:
            g, h = grad[inside].sum(), hess[inside].sum()
            best = (1e-6, None, None)
            if level < depth and len(inside) >= 20:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(bins[inside, j], grad[inside], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins[inside, j], hess[inside], len(c) + 1))[:-1]
                    n = np.cumsum(np.bincount(bins[inside, j], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    gain[(n < 8) | (n > len(inside) - 8)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            _, j, k = best
            if j is None:
                step[everyone] = RATE * g / (h + 1)
                return
            for above in (False, True):
                side = terms + [(names[j], above, float(cuts[j][k]))]
                rules.setdefault(_simplify(side), None)
                pick = lambda r: r[(bins[r, j] > k) == above]  # noqa: B023, E731
                split(pick(inside), pick(everyone), side, level + 1)

        split(rows, np.arange(len(y)), [], 0)
        score = score + step
    return list(rules)


def lasso(m: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a logistic regression, by accelerated proximal gradient."""
    n = len(y)
    w, b = np.zeros(m.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, vb, t = w.copy(), b, 1.0
    scale = 4 * n / (np.linalg.norm(m, 2) ** 2 + n)
    for _ in range(steps):
        d = 1 / (1 + np.exp(-(m @ v + vb))) - y
        new = v - scale * (m.T @ d) / n
        new = np.sign(new) * np.maximum(np.abs(new) - scale * penalty, 0)
        new_b, new_t = vb - scale * d.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return b, w


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        return 1 / (1 + np.exp(-(self.intercept + sum((w * r.holds(x) for w, r in self.rules), np.zeros(n)))))


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> Ensemble:
    """Rules and weights from statistics and labels (0, 1)."""
    if not len(y):
        return Ensemble(0.0, ())
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))), ())
    y = y.astype(np.float64)
    rules = grow_rules(x, y)
    if not rules:
        return Ensemble(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), ())
    m = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    b, w = lasso(m, y)
    return Ensemble(round(b, 9), tuple((round(float(v), 9), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-6))


def learn(statistics: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ensemble:
    """An ensemble from at most ``rows`` labelled documents that are not held out."""
    few = labelled(labels, "quality", held_out(F.col("doc_id")), "quality", rows)
    # one row of a repeated id, the least, so that a frequent id stays one row from its own partition on
    found = statistics.join(F.broadcast(few), "doc_id").groupBy("h", "y", "doc_id").agg(F.min(F.struct(*STATISTICS)).alias("x"))
    found = found.orderBy("h", "y").select("y", "x.*").collect()
    return fit({s: np.array([r[s] for r in found], np.float64) for s in STATISTICS}, np.array([r["y"] for r in found]))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    statistics = materialize(with_statistics(docs), "quality-statistics")
    ensemble = learn(statistics, labels, train_rows)
    return statistics.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.column().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
