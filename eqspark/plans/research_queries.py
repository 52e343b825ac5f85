"""Queries over checkpoints, runs and their rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, ranking, research
from ..schema import TIMELINE_MARKS_MS
from ..sources import bridge, report
from ..storage import shared_dir
from ..streaming import histories, recorder
from .curve_queries import r6, s6
from .registry import query, with_views

V = "greatest(rmse / 0.25e0, max_abs / 0.75e0)"
#: Checkpoints with one row for each (cell, time): the best.
UNIQUE = f"cps AS (SELECT cell, elapsed_ms, arg_min(rmse, ({V}, rmse, max_abs, event_id)) AS rmse, arg_min(max_abs, ({V}, rmse, max_abs, event_id)) AS max_abs FROM checkpoints GROUP BY cell, elapsed_ms)"
HISTORY = f"history AS (SELECT cell, elapsed_ms, rmse, max_abs FROM (SELECT *, ({V}, rmse, max_abs) AS m, min(({V}, rmse, max_abs)) OVER (PARTITION BY cell ORDER BY elapsed_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM cps) WHERE best IS NULL OR m < best)"


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.checkpoints(spark, sf_dir)
    key = F.struct(metrics.violation(F.col("rmse"), F.col("max_abs")).alias("v"), "rmse", "max_abs", "event_id")
    return rows.groupBy("cell", "elapsed_ms").agg(F.min(key).alias("m")).select("cell", "elapsed_ms", "m.rmse", "m.max_abs")


@query(with_views("checkpoints", UNIQUE, HISTORY) + "SELECT cell, elapsed_ms, rmse, max_abs FROM history")
def w6_best_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.best_history(_checkpoints(spark, sf_dir))


@query(with_views("checkpoints", UNIQUE) + f", marks AS (SELECT CAST(unnest([{', '.join(map(str, TIMELINE_MARKS_MS))}]) AS INTEGER) AS mark_ms) SELECT cell, mark_ms, arg_min(rmse, ({V}, rmse, max_abs, elapsed_ms)) AS rmse, arg_min(max_abs, ({V}, rmse, max_abs, elapsed_ms)) AS max_abs FROM cps JOIN marks ON elapsed_ms <= mark_ms GROUP BY cell, mark_ms")
def w7_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.timeline(_checkpoints(spark, sf_dir))


@query(with_views("checkpoints", UNIQUE, HISTORY) + "SELECT cell, " + ", ".join(f"min(elapsed_ms) FILTER ({p}) AS {n}" for n, p in research.QUALITY) + " FROM history GROUP BY cell")
def w9_time_to_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.time_to_quality(_checkpoints(spark, sf_dir))


def _summary_sql(column: str, name: str) -> str:
    return f"{s6(f'min({column})')} AS {name}_best, {s6(f'median({column})')} AS {name}_median, {s6(f'max({column})')} AS {name}_worst, {s6(f'max({column}) - min({column})')} AS {name}_spread"


_KEYS = "case_id, budget_s, max_filters"
AGGREGATES = f"""aggregates AS (SELECT {_KEYS}, count(*) AS run_count, count(*) FILTER (achieved) AS achieved_count, {_summary_sql('rmse', 'rmse')}, {_summary_sql('max_abs', 'max_abs')}, {_summary_sql('elapsed_ms', 'elapsed')},
CASE WHEN isfinite(median(coalesce(joint_ms, CAST('infinity' AS DOUBLE)))) THEN {s6("median(coalesce(joint_ms, CAST('infinity' AS DOUBLE)))")} END AS joint_median_ms, CASE WHEN count(joint_ms) = count(*) THEN {s6('max(joint_ms)')} END AS joint_worst_ms, {s6('count(*) FILTER (achieved) / count(*)')} AS achieved_rate FROM runs GROUP BY {_KEYS})"""


def _aggregates(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    out = research.aggregate_runs(bridge.runs(spark, sf_dir).where(where))
    return out.withColumns({c: r6(c) for c, t in out.dtypes if t == "double"})


@query(with_views("runs", AGGREGATES) + "SELECT * FROM aggregates")
def a9_aggregate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregates(spark, sf_dir)


@query(with_views("runs") + f"SELECT {_KEYS}, termination, count(*) AS n FROM runs GROUP BY {_KEYS}, termination")
def a9_termination_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = research.termination_counts(bridge.runs(spark, sf_dir))
    return per.select(*research.RUN_KEYS, F.explode("reasons").alias("termination", "n"))


@query(with_views("runs", AGGREGATES) + "SELECT * FROM aggregates")
def k12_research_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artefacts of a report written (summary, results, warnings, deltas, metadata) and the results read back; the summary must have a table row for each cell."""
    where = f"{shared_dir(spark)}/eqspark/reports/{uuid.uuid4().hex}"
    out = _aggregates(spark, sf_dir)
    report.write(where, out, research.compare(out, out, _VALUES), research.monotonicity_warnings(out), metadata={"source": "runs"})
    read = spark.read.schema(out.schema).json(f"{where}/results")
    told = spark.read.text(f"{where}/summary", wholetext=True).first()[0]
    cells = [line for line in told.split("## Quality and runtime")[1].split("## Time")[0].splitlines() if line.startswith("| ")]
    if len(cells) - 2 != read.count():
        raise ValueError("the summary lacks cells")
    return read


_HALVES = AGGREGATES.replace("aggregates AS", "a0 AS").replace("FROM runs", "FROM runs WHERE termination = 'F'") + ",\n" + AGGREGATES.replace("aggregates AS", "a1 AS").replace("FROM runs", "FROM runs WHERE termination = 'O'")
_VALUES = ["rmse_median", "max_abs_median", "achieved_rate", "joint_median_ms", "elapsed_median"]


@query(with_views("runs", _HALVES) + f"SELECT {_KEYS}, " + ", ".join(f"{s6(f'a1.{v} - a0.{v}')} AS {v}_delta, CASE WHEN a0.{v} <> 0 THEN {s6(f'(a1.{v} - a0.{v}) / a0.{v} * 100')} END AS {v}_percent" for v in _VALUES) + f" FROM a1 JOIN a0 USING ({_KEYS})")
def j13_compare_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as candidates against filled ones as the baseline."""
    out = research.compare(_aggregates(spark, sf_dir, "termination = 'O'"), _aggregates(spark, sf_dir, "termination = 'F'"), _VALUES)
    return out.withColumns({c: r6(c) for c in out.columns if c not in research.RUN_KEYS})


@query(with_views("runs", AGGREGATES) + f"""SELECT s.case_id, s.max_filters, s.budget_s AS shorter_s, l.budget_s AS longer_s, {s6('l.rmse_median - s.rmse_median')} AS rmse_delta, {s6('l.max_abs_median - s.max_abs_median')} AS max_abs_delta, l.rmse_median - s.rmse_median > 0.05e0 AS rmse_trigger, l.max_abs_median - s.max_abs_median > 0.10e0 AS max_abs_trigger
FROM aggregates AS s JOIN aggregates AS l ON s.case_id = l.case_id AND s.max_filters = l.max_filters AND ((s.budget_s = 15 AND l.budget_s = 30) OR (s.budget_s = 30 AND l.budget_s = 60)) WHERE l.rmse_median - s.rmse_median > 0.05e0 OR l.max_abs_median - s.max_abs_median > 0.10e0""")
def j14_monotonicity_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.monotonicity_warnings(_aggregates(spark, sf_dir)).withColumns({"rmse_delta": r6("rmse_delta"), "max_abs_delta": r6("max_abs_delta")})


@query("""SELECT DISTINCT case_id, budget_s, max_filters, CASE WHEN case_id = 'b' AND budget_s = 15 AND max_filters = 10 THEN 'deep' ELSE 'light' END AS mode FROM (
    SELECT case_id, budget_s, max_filters FROM (VALUES ('a'), ('b'), ('c')) AS c(case_id), (VALUES (5), (15), (30), (60)) AS b(budget_s), (VALUES (10), (20), (40)) AS m(max_filters) UNION ALL SELECT unnest(['a', 'b', 'c']), 120, 10)""")
def g8_research_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.research_cells(spark, ["a", "b", "c"], [5, 15, 30, 60], [10, 20, 40], longest=True, profile=("b", 15))


# --- rankings over solutions: one for each part supplied -----------------------------------------

SOLUTIONS = """solutions AS (SELECT o_custkey % 97 AS grp, o_orderkey AS id, round((o_orderkey % 100) / 200e0, 6) AS rmse, round((o_orderkey % 70) / 50e0, 6) AS max_abs, round((o_orderkey % 13) / 10e0, 6) AS cancellation, CAST(o_orderkey % 11 AS INTEGER) AS n,
round(CAST(o_totalprice AS DOUBLE) / 50000e0, 6) AS max_q, CAST(o_orderkey % 15 AS DOUBLE) AS max_gain, CAST(o_orderkey % 40 AS DOUBLE) AS sum_gain, o_orderkey % 2 = 0 AS stagnant FROM orders)"""


def _solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return bridge.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 97).alias("grp"), k.alias("id"), F.round((k % 100) / 200e0, 6).alias("rmse"), F.round((k % 70) / 50e0, 6).alias("max_abs"), F.round((k % 13) / 10e0, 6).alias("cancellation"), (k % 11).cast("int").alias("n"),
        F.round(F.col("o_totalprice").cast("double") / 50000e0, 6).alias("max_q"), (k % 15).cast("double").alias("max_gain"), (k % 40).cast("double").alias("sum_gain"), (k % 2 == 0).alias("stagnant"),
    )


_ORDER = f"{V}, rmse, max_abs, cancellation, max_q, max_gain, sum_gain, n, id"
_MET = "(rmse <= 0.25 AND max_abs <= 0.75)"


@query(with_views(SOLUTIONS) + f"SELECT grp, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY {_ORDER}) AS INTEGER) AS rank FROM solutions")
def o5_rank_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_solutions(_solutions(spark, sf_dir), "grp", "id").select("grp", "id", "rank")


@query(with_views(SOLUTIONS) + f"SELECT grp, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY {_MET} DESC, round(sqrt(power(rmse / 0.25e0, 2) + power(max_abs / 0.75e0, 2)), 9), {_ORDER}) AS INTEGER) AS rank FROM solutions")
def o6_rank_deliverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_deliverable(_solutions(spark, sf_dir), "grp", "id").select("grp", "id", "rank")


_TIED = "tied AS (SELECT l_orderkey % 7 AS grp, l_orderkey AS id, list({'f': f, 'type': CASE type WHEN 'LS' THEN 0 WHEN 'PK' THEN 1 ELSE 2 END, 'gain': gain, 'q': q} ORDER BY ordinal) AS x FROM (SELECT preset_id AS l_orderkey, * FROM filters) GROUP BY l_orderkey)"


@query(with_views("filters", _TIED) + "SELECT grp, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY x, id) AS INTEGER) AS rank FROM tied")
def o5_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions of equal metrics are ranked filter by filter."""
    sets = bridge.filters(spark, sf_dir).groupBy("preset_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "f", "type", "gain", "q"))).alias("filters"))
    equal = {c: F.lit(0.1) for c in ("rmse", "max_abs", "cancellation", "max_q", "max_gain", "sum_gain")} | {"n": F.lit(1), "grp": F.col("preset_id") % 7, "id": F.col("preset_id")}
    return ranking.rank_solutions(sets.withColumns(equal), "grp", "id").select("grp", "id", "rank")


@query(with_views(SOLUTIONS) + f"SELECT id, {_MET} AS achieved, {s6(V)} AS violation, {s6('sqrt(power(rmse / 0.25e0, 2) + power(max_abs / 0.75e0, 2))')} AS distance FROM solutions")
def p17_target_achieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = F.col("rmse"), F.col("max_abs")
    return _solutions(spark, sf_dir).select("id", metrics.target_achieved(r, m).alias("achieved"), r6(metrics.violation(r, m)).alias("violation"), r6(metrics.distance(r, m)).alias("distance"))


@query(with_views(SOLUTIONS) + f""", v AS (SELECT *, {V} AS violation, min({V}) OVER (PARTITION BY grp) AS best, CAST(row_number() OVER (PARTITION BY grp ORDER BY {V}, rmse, max_abs, id) AS INTEGER) AS rank FROM solutions),
k AS (SELECT *, sum(CAST(violation <= best * 1.02e0 AS INTEGER)) OVER (PARTITION BY grp) AS near FROM v)
SELECT grp, id, rank FROM k WHERE (violation <= best * 1.02e0 OR (stagnant AND near < 3 AND rank = near + 1)) AND rank <= 3""")
def o10_retained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.retained_paths(_solutions(spark, sf_dir), "grp", "id").select("grp", "id", "rank")


_LESS = " AND ".join(f"t.{m} <= s.{m} + 1e-12" for m in ("n", "rmse", "max_abs", "cancellation")) + " AND (" + " OR ".join(f"t.{m} < s.{m} - 1e-12" for m in ("n", "rmse", "max_abs", "cancellation")) + ")"


@query(with_views(SOLUTIONS) + f"SELECT grp, id FROM solutions AS s WHERE NOT EXISTS (SELECT 1 FROM solutions AS t WHERE t.grp = s.grp AND {_LESS})")
def j15_pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pareto_front(_solutions(spark, sf_dir), "grp").select("grp", "id")


_LESS2 = " AND ".join(f"t.{m} <= s.{m} + 1e-12" for m in ("rmse", "max_abs")) + " AND (" + " OR ".join(f"t.{m} < s.{m} - 1e-12" for m in ("rmse", "max_abs")) + ")"
_REFERENCE = f"CASE WHEN {_MET} THEN (0e0, CAST(n AS DOUBLE), rmse, max_abs, cancellation, 0e0, id) ELSE (1e0, {V}, rmse, max_abs, cancellation, CAST(n AS DOUBLE), id) END"


@query(with_views(SOLUTIONS) + f"SELECT grp, id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_REFERENCE}) AS place FROM solutions AS s WHERE NOT EXISTS (SELECT 1 FROM solutions AS t WHERE t.grp = s.grp AND {_LESS2})) WHERE place <= 2")
def j15_retained_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.retain_beam(_solutions(spark, sf_dir), "grp", 2).select("grp", "id")


@query(with_views(SOLUTIONS) + f"SELECT grp, arg_min(id, k) AS id FROM (SELECT *, CASE WHEN {_MET} THEN (0e0, CAST(n AS DOUBLE), rmse, max_abs, cancellation, 0e0, id) ELSE (1e0, {V}, rmse, max_abs, cancellation, CAST(n AS DOUBLE), id) END AS k FROM solutions) GROUP BY grp")
def o16_reference_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.reference_point(_solutions(spark, sf_dir), "grp").select("grp", "id")


CANDIDATES = "candidates AS (SELECT l_orderkey % 499 AS grp, l_suppkey % 5 AS feature, l_linestatus AS mode, CASE l_returnflag WHEN 'A' THEN 'PK' WHEN 'N' THEN 'LS' ELSE 'HS' END AS type, CAST(l_partkey AS DOUBLE) AS f, CAST(l_discount AS DOUBLE) AS gain, CAST(l_quantity AS DOUBLE) AS q, round(CAST(l_extendedprice AS DOUBLE), 2) AS score, l_orderkey AS ordinal FROM lineitem)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    kind = F.when(F.col("l_returnflag") == "A", "PK").when(F.col("l_returnflag") == "N", "LS").otherwise("HS")
    return bridge.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 499).alias("grp"), (F.col("l_suppkey") % 5).alias("feature"), F.col("l_linestatus").alias("mode"), kind.alias("type"), d("l_partkey").alias("f"), d("l_discount").alias("gain"), d("l_quantity").alias("q"), F.round(d("l_extendedprice"), 2).alias("score"), F.col("l_orderkey").alias("ordinal"))


_BEST = "score DESC, f, CASE type WHEN 'LS' THEN 0 WHEN 'PK' THEN 1 ELSE 2 END, gain, q, ordinal"


@query(with_views(CANDIDATES) + f""", r AS (SELECT *, row_number() OVER (PARTITION BY grp, feature, mode ORDER BY {_BEST}) = 1 AS representative FROM candidates),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY representative DESC, {_BEST}) AS INTEGER) AS rank FROM r) SELECT grp, rank, score, f, representative FROM k WHERE rank <= 8""")
def o2_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shortlist(_candidates(spark, sf_dir), "grp").select("grp", "rank", "score", "f", "representative")


@query(with_views(CANDIDATES) + "SELECT grp, type, f, min(ordinal) AS ordinal FROM candidates GROUP BY grp, type, f")
def d2_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_of_key(_candidates(spark, sf_dir), ["grp", "type", "f"], "ordinal").select("grp", "type", "f", "ordinal")


PROPOSALS = "proposals AS (SELECT o_custkey % 97 AS grp, o_orderpriority AS mutation, CAST(o_orderkey AS VARCHAR) AS key, round(CAST(o_totalprice AS DOUBLE) / 1000e0, 6) AS rmse FROM (SELECT o_custkey, o_orderkey, min(o_orderpriority) AS o_orderpriority, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey, o_orderkey))"


@query(with_views(PROPOSALS) + """, a AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mutation, key) AS name FROM proposals),
b AS (SELECT *, name > 6 AND row_number() OVER (PARTITION BY grp, name <= 6 ORDER BY rmse, mutation, key) <= 2 AS second FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN name <= 6 THEN 0 WHEN second THEN 1 ELSE 2 END, CASE WHEN second THEN rmse END NULLS FIRST, name) AS place FROM b)
SELECT grp, key, CAST(place AS INTEGER) AS place FROM c WHERE place <= 8""")
def o14_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bridge.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderkey").agg(F.min("o_orderpriority").alias("mutation"), F.min("o_totalprice").alias("p"))
    rows = o.select((F.col("o_custkey") % 97).alias("grp"), "mutation", F.col("o_orderkey").cast("string").alias("key"), F.round(F.col("p").cast("double") / 1000e0, 6).alias("rmse"))
    return ranking.quota(rows, "grp").select("grp", "key", "place")


@query(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word FROM documents)
SELECT doc_id, word, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY icu_sort_key(word, 'root'), word) AS INTEGER) AS place FROM w""")
def o13_collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of each document, with their case, digits, marks and accents, in the order of proposals' names."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = bridge.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(words)).alias("mutation")).withColumn("key", F.lit(""))
    return ranking.ordered(rows, "doc_id").select("doc_id", F.col("mutation").alias("word"), "place")


@query(with_views("filters") + "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT preset_id FROM filters WHERE enabled)")
def d7_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key no enabled filter has."""
    seen = bridge.filters(spark, sf_dir).where("enabled").select(F.col("preset_id").alias("o_orderkey"))
    return ranking.unseen(bridge.table(spark, sf_dir, "orders").select("o_orderkey"), seen, "o_orderkey")


@query("SELECT vec_id, count(*) AS n FROM (SELECT vec_id FROM embeddings UNION ALL SELECT min(vec_id) FROM embeddings GROUP BY label) GROUP BY vec_id HAVING count(*) > 1")
def d14_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.table(spark, sf_dir, "embeddings")
    both = e.select("vec_id").unionByName(e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id"))
    return both.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- change history ----------------------------------------------------------------------------

_GAP = 3_600_000  # an hour: events are sparse


@query(f"""WITH e AS (SELECT user_id AS cell, ts, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > {_GAP * 1000} AS fresh FROM events),
s AS (SELECT *, sum(CAST(coalesce(fresh, TRUE) AS INTEGER)) OVER (PARTITION BY cell ORDER BY ts) AS burst FROM e)
SELECT cell, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n, arg_max(event_type, (ts, event_type)) AS value FROM s GROUP BY cell, burst""")
def t2_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = recorder.debounce(e, "cell", "ts", "event_type", _GAP)
    return out.select("cell", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n", "value")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1 OR before IS DISTINCT FROM event_type")
def t1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return recorder.changes(e, "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


# without pins the newest snapshot always holds the state of the event before, and its time is that of the last change
_RECORDED = """e AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(trunc(epoch_us(ts) / 3600000) AS BIGINT) AS at_ms, event_id AS seq, event_type AS state FROM events),
c AS (SELECT *, lag(state) OVER w IS NOT DISTINCT FROM state AND row_number() OVER w > 1 AS same FROM e WINDOW w AS (PARTITION BY key ORDER BY at_ms, seq)),
d AS (SELECT *, max(CASE WHEN NOT same THEN at_ms END) OVER (PARTITION BY key ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM c),
o AS (SELECT *, CASE WHEN same THEN 'same' WHEN at_ms - newest < 1000 THEN 'replaced' ELSE 'appended' END AS outcome FROM d),
recorded AS (SELECT key, at_ms, state, outcome, CAST(least(100, count(*) FILTER (outcome = 'appended') OVER (PARTITION BY key ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS kept FROM o)"""


def _snapshots(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000).cast("long").alias("at_ms"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))


@query(f"WITH {_RECORDED} SELECT * FROM recorded")
def t3_record_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as snapshots, an hour standing for a second."""
    return recorder.record_batch(_snapshots(bridge.table(spark, sf_dir, "events")))


_DELAY_MS = 5000


@query(f"WITH {_RECORDED} SELECT * FROM recorded WHERE at_ms < (SELECT max(at_ms) FROM recorded) - {_DELAY_MS}")
def t3_history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, with state and timers: what the watermark has passed when the table is read."""
    where = f"{shared_dir(spark)}/eqspark/streams/{uuid.uuid4().hex}"
    table = f"{sf_dir}/events.parquet"
    with histories.with_rocksdb(spark):
        events = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table[:-1]}[{table[-1]}]")  # a pattern, as a table may be one file
        out = histories.recorded_stream(_snapshots(events), 0, f"{_DELAY_MS} milliseconds")
        out.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{where}/out").awaitTermination()
    return spark.read.schema(histories.OUTCOME).parquet(f"{where}/out")
