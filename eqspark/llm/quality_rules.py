"""Quality rules with robust multivariate outlier rejection (minimum covariance determinant).

Word and line statistics of every whole text are column expressions. The verdict is a deterministic
minimum-covariance-determinant (MCD) estimate per (language, source). Three starts compete: medians with MADs, the scatter of hyperbolic tangents
and the scatter of spatial signs of the standardized rows. Each takes the subset of at least ``H_SHARE`` of the rows with the smallest distances and
refits mean and covariance, ``FIRST_STEPS`` times; the start with the least determinant goes on until no group's determinant changes (``MAX_STEPS`` at most).
Rows are rejected whose Mahalanobis distance, made consistent by its median, is beyond ``CUTOFF``. For this last distance alone, a variance below the square of its statistic's
``FLOORS`` is raised to that, so that a statistic that hardly varies rejects nothing by itself; the steps only have a ridge of ``RIDGE`` of it against singular
subsets. Groups with fewer than ``MIN_ROWS`` usable rows use
their language's estimate, then that of all rows, then none (every row is kept).

All statistics are transformed and rounded to integers (``SCALE`` steps a unit), so sums are exact in any order
and quantiles hold a bounded number of distinct values however many rows a group has.

Edge cases: a null text has no words (all zero, base-failed); a null language or source is a group of its own;
rows at equal (binned) distance are all in the subset or all out; repeated rows are judged each; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, small_side

SCALE = 1024
H_SHARE = 0.75
FIRST_STEPS, MAX_STEPS = 2, 20
MIN_ROWS = 100
#: Squared Mahalanobis distances are held as floor(LOG_STEPS * ln(1 + d2)).
LOG_STEPS = 64
#: Statistics are rejected beyond this squared distance: chi-square(5) at 1 - 1e-5.
CUTOFF = 30.86
#: Median of chi-square(5): makes the estimates consistent.
CHI2_MEDIAN = 4.351460191095526
#: Least standard deviation of each transformed statistic in the last distance, so that one that hardly varies rejects nothing by itself.
FLOORS = (1.0, 0.15, 0.06, 0.06, 0.10)
#: Share of the squared floors (and of the unit variances of a start's scatter) that is added to every variance.
RIDGE = 0.01
DIM = len(FLOORS)
#: (name, expression over the base statistics); the same text runs in Spark and in other SQL engines.
FEATURES = (
    ("v0", "ln(1.0e0 + n_words)"),
    ("v1", "sqrt(word_chars / (n_words + 0.0e0))"),
    ("v2", "sqrt(n_symbols / (word_chars + 0.0e0))"),
    ("v3", "sqrt(n_dup_lines / (n_words + 0.0e0))"),
    ("v4", "n_repeat_words / (n_words + 0.0e0)"),
)
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, though the body names it often."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: sort (hash, place), keep windows beside an equal one, add up the places they cover."""

    def windows(w: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return _let(F.sort_array(places), twice)

    def twice(s: Column) -> Column:
        found = F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"]))
        return covered(F.sort_array(F.transform(found, lambda x: x["i"])))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(words) >= 4, windows(words)).otherwise(F.lit(0).cast("long"))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_eq_words": word_array(F.col(text)), "_eq_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_eq_words").cast("long"),
            "word_chars": F.char_length(F.regexp_replace(t, SPACE_CLASS, "")).cast("long"),
            "n_symbols": (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_eq_lines") - F.size(F.array_distinct("_eq_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_eq_words")),
        }
    )
    return out.withColumn("base_failed", F.expr(BASE_FAILED)).drop("_eq_words", "_eq_lines")


# --- expressions over v0, v1, ... --------------------------------------------------------------


def feature_sql() -> str:
    return ", ".join(f"CAST(round({SCALE} * {e}) AS BIGINT) AS {n}" for n, e in FEATURES)


def log_sql(d2: str) -> str:
    return f"CAST(floor({LOG_STEPS} * ln(1.0e0 + ({d2}))) AS BIGINT)"


def moments_sql() -> str:
    first = [f"sum(CAST(v{k} AS DOUBLE)) AS s{k}" for k in range(DIM)]
    second = [f"sum(CAST(v{i} * v{j} AS DOUBLE)) AS s{i}_{j}" for i in range(DIM) for j in range(i + 1)]
    return ", ".join(["count(*) AS h", *first, *second])


def mean_sql() -> str:
    return ", ".join(f"s{k} / h AS m{k}" for k in range(DIM))


def covariance_sql(raised: bool) -> str:
    """Covariances with the ridge; ``raised``: variances are at least the squared floors."""
    parts = []
    for i in range(DIM):
        for j in range(i + 1):
            value, floor = f"s{i}_{j} / h - (s{i} / h) * (s{j} / h)", (FLOORS[i] * SCALE) ** 2
            if i == j:
                value = (f"greatest({value}, {floor!r}e0)" if raised else value) + f" + {RIDGE * floor!r}e0"
            parts.append(f"{value} AS c{i}_{j}")
    return ", ".join(parts)


def cholesky_steps() -> list[str]:
    """Select lists, one after the other: column i of the lower factor needs the earlier ones."""
    steps = []
    for j in range(DIM):
        inner = "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        steps.append(f"sqrt(c{j}_{j}{inner}) AS l{j}_{j}")
        below = [f"(c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + f") / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, DIM)]
        if below:
            steps.append(", ".join(below))
    return steps


def solve_steps() -> list[str]:
    """Forward substitution y = L^-1 (v - m)."""
    return [f"((v{i} - m{i})" + "".join(f" - l{i}_{k} * y{k}" for k in range(i)) + f") / l{i}_{i} AS y{i}" for i in range(DIM)]


def squared_sql() -> str:
    return " + ".join(f"y{k} * y{k}" for k in range(DIM))


# --- the estimate ------------------------------------------------------------------------------

KEYS = ["level", "g_lang", "g_source"]
LOWER = [f"l{i}_{j}" for i in range(DIM) for j in range(i + 1)]
MODEL = [f"m{k}" for k in range(DIM)] + LOWER
V = [f"v{k}" for k in range(DIM)]


def _select(df: DataFrame, exprs: str) -> DataFrame:
    return df.selectExpr("*", *_split(exprs))


def _split(exprs: str) -> list[str]:
    """Split a select list at commas outside brackets."""
    out, depth, last = [], 0, 0
    for at, c in enumerate(exprs):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(exprs[last:at])
            last = at + 1
    return [*out, exprs[last:]]


def _factor(df: DataFrame) -> DataFrame:
    """``df`` (c0_0, c1_0, ...) with the lower factor and det, the root of the determinant."""
    for step in cholesky_steps():
        df = _select(df, step)
    return df.withColumn("det", F.expr(" * ".join(f"l{k}_{k}" for k in range(DIM))))


SUMS = ["h", *[f"s{k}" for k in range(DIM)], *[f"s{i}_{j}" for i in range(DIM) for j in range(i + 1)]]


def _starts(usable: DataFrame, med: DataFrame, mad: DataFrame, n_groups: int) -> DataFrame:
    """KEYS, start, the model of each start, in units of the statistics."""
    scale = [f"greatest(1.4826e0 * a{k}, {FLOORS[k] * SCALE!r}e0) AS d{k}" for k in range(DIM)]
    base = materialize(med.join(mad, KEYS).selectExpr(*KEYS, *[f"m{k}" for k in range(DIM)], *scale), "mcd-scales")
    z = usable.join(small_side(base, n_groups), KEYS).selectExpr(*KEYS, *[f"(v{k} - m{k}) / d{k} AS z{k}" for k in range(DIM)])
    z = z.withColumn("r", F.expr("sqrt(" + " + ".join(f"z{k} * z{k}" for k in range(DIM)) + ")"))
    # whole numbers again, so that sums do not depend on the order of rows
    bent = [F.struct(F.lit(1).alias("start"), *[F.expr(f"CAST(round({SCALE} * tanh(z{k})) AS BIGINT)").alias(f"v{k}") for k in range(DIM)])]
    bent += [F.struct(F.lit(2).alias("start"), *[F.expr(f"CASE WHEN r > 0 THEN CAST(round({SCALE} * z{k} / r) AS BIGINT) ELSE 0 END").alias(f"v{k}") for k in range(DIM)])]
    sums = z.select(*KEYS, F.explode(F.array(*bent)).alias("x")).select(*KEYS, "x.*").groupBy(*KEYS, "start").agg(*[F.expr(e) for e in _split(moments_sql())])
    scatter = ", ".join(f"s{i}_{j} / h / {SCALE**2}e0" + (f" + {RIDGE}e0" if i == j else "") + f" AS c{i}_{j}" for i in range(DIM) for j in range(i + 1))
    factors = _factor(_select(sums, scatter)).select(*KEYS, "start", *LOWER)
    unit = base.select(*KEYS, F.lit(0).alias("start"), *[F.lit(float(i == j)).alias(f"l{i}_{j}") for i in range(DIM) for j in range(i + 1)])
    out = factors.unionByName(unit).join(base, KEYS)
    return out.selectExpr(*KEYS, "start", *[f"m{k}" for k in range(DIM)], *[f"d{i} * l{i}_{j} AS l{i}_{j}" for i in range(DIM) for j in range(i + 1)])


def _distances(rows: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """``rows`` with d2, once for each start of their group's models (``n`` rows)."""
    out = rows.join(small_side(model, n), KEYS)
    for step in solve_steps():
        out = _select(out, step)
    return out.withColumn("d2", F.expr(squared_sql()))


def _refit(rows: DataFrame, model: DataFrame, n: int, keys: list[str], raised: bool = False) -> DataFrame:
    """Mean, Cholesky factor and det of the rows of each group whose binned distance by ``model`` is within its ``H_SHARE`` quantile; ties stay.

    One pass: moments are summed by bin (some hundreds a group), and the bins up to the quantile are added up.
    """
    bins = _distances(rows, model, n).withColumn("b", F.expr(log_sql("d2"))).groupBy(*keys, "b").agg(*[F.expr(e) for e in _split(moments_sql())])
    group = Window.partitionBy(*keys)
    bins = bins.withColumns({"_upto": F.sum("h").over(group.orderBy("b")), "_all": F.sum("h").over(group)}).where(f"_upto - h < {H_SHARE}e0 * _all")
    sums = bins.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    return _factor(_select(sums, mean_sql() + ", " + covariance_sql(raised))).select(*keys, *MODEL, "det")


def determinants(usable: DataFrame, n_groups: int) -> DataFrame:
    """KEYS, the model of least determinant and det of each group of ``usable`` (KEYS, v0..v4)."""
    med = materialize(usable.groupBy(*KEYS).agg(*[F.expr(f"percentile(v{k}, 0.5e0)").alias(f"m{k}") for k in range(DIM)]), "mcd-medians")
    mad = usable.join(small_side(med, n_groups), KEYS).groupBy(*KEYS).agg(*[F.expr(f"percentile(abs(v{k} - m{k}), 0.5e0)").alias(f"a{k}") for k in range(DIM)])
    keys = [*KEYS, "start"]
    model = materialize(_starts(usable, med, mad, n_groups), "mcd-starts")
    for _ in range(FIRST_STEPS):
        model = materialize(_refit(usable, model, 3 * n_groups, keys), "mcd-model")
    best = model.groupBy(*KEYS).agg(F.min_by(F.struct(*MODEL, "det"), F.struct("det", "start")).alias("x"))
    model = materialize(best.select(*KEYS, "x.*"), "mcd-model")
    for _ in range(MAX_STEPS):
        new = materialize(_refit(usable, model, n_groups, KEYS), "mcd-model")
        settled = new.join(small_side(model.select(*KEYS, F.col("det").alias("old")), n_groups), KEYS).where("det <> old").isEmpty()
        model = new
        if settled:
            break
    return model


def estimate(stats: DataFrame) -> DataFrame:
    """MCD estimates from rows (g_lang, g_source, v0..v4), one row per (g_lang, g_source) with the estimate that holds for it (has_model false: none)."""
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), a.alias("g_lang"), b.alias("g_source")) for n, a, b in ((2, F.col("g_lang"), F.col("g_source")), (1, F.col("g_lang"), F.lit("")), (0, F.lit(""), F.lit("")))]))
    rows = stats.select(levels.alias("k"), *V).select("k.*", *V)
    sizes = materialize(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), "mcd-groups")
    n_groups = sizes.count()
    usable = materialize(rows.join(small_side(sizes.where(f"n >= {MIN_ROWS}").drop("n"), n_groups), KEYS), "mcd-rows")
    model = materialize(_refit(usable, determinants(usable, n_groups), n_groups, KEYS, raised=True), "mcd-raised")
    scale = _distances(usable, model, n_groups).withColumn("b", F.expr(log_sql("d2"))).groupBy(*KEYS).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY b)").alias("mid"))
    whole = materialize(model.join(scale, KEYS), "mcd-final")
    groups = sizes.where("level = 2").select("g_lang", "g_source")
    own = whole.where("level = 2").drop("level").withColumn("o", F.lit(2))
    lang = whole.where("level = 1").drop("level", "g_source").withColumn("o", F.lit(1))
    both = whole.where("level = 0").drop("level", "g_source", "g_lang").withColumn("o", F.lit(0))
    names = [*MODEL, "mid"]
    out = groups.join(own.select("g_lang", "g_source", F.struct(*names).alias("s2")), ["g_lang", "g_source"], "left")
    out = out.join(small_side(lang.select("g_lang", F.struct(*names).alias("s1")), n_groups), ["g_lang"], "left")
    out = out.join(F.broadcast(both.select(F.struct(*names).alias("s0"))), F.lit(True), "left")  # one row at most
    pick = F.coalesce("s2", "s1", "s0")
    return out.select("g_lang", "g_source", pick.isNotNull().alias("has_model"), *[pick[n].alias(n) for n in names])


def _grouped(docs: DataFrame) -> DataFrame:
    """Prefixes keep a null language apart from an empty one, and either from the wider levels' keys."""
    key = lambda c: F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c).cast("string")))
    return docs.withColumns({"g_lang": key("lang"), "g_source": key("source")})


VERDICT = f"NOT base_failed AND (NOT coalesce(has_model, false) OR d2 * {CHI2_MEDIAN}e0 <= {CUTOFF}e0 * greatest(exp((mid + 0.5e0) / {LOG_STEPS}) - 1.0e0, {CHI2_MEDIAN / 2}e0))"


def judge(stats: DataFrame) -> DataFrame:
    """``stats`` (with_base's columns, lang, source; materialized by the caller) with d2 and kept."""
    keyed = _grouped(stats)
    usable = keyed.where("NOT base_failed").selectExpr("g_lang", "g_source", *_split(feature_sql()))
    model = materialize(estimate(usable), "mcd-by-group")
    n = model.count()
    out = keyed.withColumns({f"v{k}": F.expr(f"CASE WHEN n_words > 0 THEN CAST(round({SCALE} * {e}) AS BIGINT) ELSE 0 END") for k, (_, e) in enumerate(FEATURES)})
    out = out.join(small_side(model, n), ["g_lang", "g_source"], "left")
    for step in solve_steps():
        out = _select(out, step)
    out = out.withColumn("d2", F.expr(squared_sql())).withColumn("kept", F.expr(VERDICT))
    return out.select(*stats.columns, F.when(F.col("base_failed"), F.lit(None).cast("double")).otherwise(F.col("d2") * CHI2_MEDIAN / F.expr(f"greatest(exp((mid + 0.5e0) / {LOG_STEPS}) - 1.0e0, {CHI2_MEDIAN / 2}e0)")).alias("distance2"), "kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of each row of ``docs`` (doc_id, text, lang, source): doc_id, statistics, base_failed, distance2, kept."""
    stats = materialize(with_base(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-stats")
    return judge(stats).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns (which may be any)."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row_"), "text", "lang", "source")
    judged = judge(materialize(with_base(packed).drop("text"), "quality-rows"))
    return judged.where("kept").select(*[F.col("row_")[n].alias(c) for c, n in zip(docs.columns, names, strict=True)])
