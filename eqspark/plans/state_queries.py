"""Queries over workspaces, sessions, results and the texts that name them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import acceptance, curves, filters as ops, grids, keys, metrics, presets, ranking, research, runner, workspace
from ..schema import POINTS_PER_OCTAVE
from ..sources import bridge, session
from ..storage import shared_dir
from ..streaming import recorder
from . import curve_queries as cq
from . import filter_queries as fq
from . import oracle_dsp as dsp
from .curve_queries import CURVE_VIEWS, r6, s6
from .registry import query, with_views


def js(x: str) -> str:
    """A number's JSON text in SQL."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


# --- derived curves ----------------------------------------------------------------------------


@query(with_views(*CURVE_VIEWS) + f"SELECT pair_id, w.idx, {s6('p.db + w.db / 2')} AS db FROM wanted AS w JOIN prepared AS p ON p.curve_id = pair_id AND p.idx = w.idx")
def p4_apply_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each response with half of its wanted correction applied."""
    wanted = cq.wanted(spark, sf_dir)
    source = cq.prepared(spark, sf_dir).withColumnRenamed("curve_id", "pair_id")
    return curves.apply_eq(source, wanted.withColumn("db", F.col("db") / 2), ["pair_id", "idx"]).select("pair_id", "idx", r6("db").alias("db"))


@query(with_views(*CURVE_VIEWS) + f"SELECT pair_id, idx, {s6('db - round(db)')} AS db FROM wanted")
def p5_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a correction in whole dB leaves."""
    wanted = cq.wanted(spark, sf_dir)
    return curves.residual(wanted, wanted.withColumn("db", F.round("db")), ["pair_id", "idx"]).select("pair_id", "idx", r6("db").alias("db"))


_CANDIDATES = [("PK", 100.0, 3.0, 1.0), ("PK", 1000.0, -4.0, 2.0), ("PK", 5000.0, 6.0, 4.0), ("LS", 120.0, 2.0, 0.7), ("HS", 8000.0, -2.0, 0.7)]
_CANDIDATE_SQL = "candidates(candidate, type, f, gain, q) AS (VALUES " + ", ".join(f"({i}, '{t}', {f}e0, {g}e0, {q}e0)" for i, (t, f, g, q) in enumerate(_CANDIDATES)) + ")"


@query(with_views(*CURVE_VIEWS, _CANDIDATE_SQL, dsp.coefficients("shapes", "candidates", "candidate")) + f""", r AS (SELECT candidate, g.idx, {dsp.response()} AS r FROM shapes, grid AS g)
SELECT pair_id, candidate, round(sum(db * db - (db - r) * (db - r)), 4) + 0.0e0 AS score FROM wanted JOIN r USING (idx) GROUP BY pair_id, candidate""")
def a14_cheap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five candidates for every pair."""
    rows = spark.createDataFrame([(0, i, True, *x) for i, x in enumerate(_CANDIDATES)], "preset_id long, ordinal int, enabled boolean, type string, f double, gain double, q double")
    responses = ops.responses(rows, grids.grid_frame(spark, grids.evaluation_grid())).select(F.col("ordinal").alias("candidate"), "idx", F.col("db").alias("r"))
    from ..operators import features

    return features.cheap_score(cq.wanted(spark, sf_dir), responses, "pair_id", "candidate").withColumn("score", F.round("score", 4) + F.lit(0.0))


_CLAIMED = f"truth AS (SELECT pair_id, avg(abs(db)) AS mae, sqrt(avg(db * db)) AS rmse, max(abs(db)) AS max_abs FROM wanted GROUP BY pair_id)"


@query(with_views(*CURVE_VIEWS, _CLAIMED) + f"SELECT pair_id, {s6('CASE WHEN pair_id % 5 = 0 THEN 0.001e0 ELSE 0.5e0 END')} AS worst FROM truth WHERE pair_id % 5 = 0 OR pair_id % 7 = 0")
def a26_drifted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of which every fifth has another rmse and every seventh another largest deviation (or both)."""
    truth = cq.errors(spark, sf_dir)
    claim = truth.withColumns({"rmse": F.col("rmse") + F.when(F.col("pair_id") % 5 == 0, 0.001).otherwise(4e-6), "max_abs": F.col("max_abs") + F.when((F.col("pair_id") % 7 == 0) & (F.col("pair_id") % 5 != 0), 0.5).otherwise(0.0)})
    return acceptance.drifted(claim, truth, ["pair_id"]).withColumn("worst", r6("worst"))


_SPACE = f"""spaces AS (SELECT fr_id AS workspace_id, fr_id, CASE WHEN fr_id % 7 = 0 THEN NULL ELSE target_id END AS target_id FROM pairs),
short AS (SELECT * FROM points WHERE NOT (curve_id % 11 = 3 AND idx = 63)),
states AS (SELECT workspace_id, s.fr_id, s.target_id, CASE WHEN s.fr_id % 11 = 3 OR coalesce(s.target_id % 11 = 3, FALSE) THEN 'coverage-error' WHEN s.target_id IS NULL THEN 'incomplete' ELSE 'ready' END AS status FROM spaces AS s)"""
_EQ = "eq AS (SELECT preset_id, g.idx, sum(" + dsp.response() + ") AS db FROM coefs, grid AS g WHERE enabled AND preset_id IN (SELECT vec_id FROM embeddings) GROUP BY preset_id, g.idx)"


def _workspace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs as workspaces with the filters of the order that has their id; every seventh has no target, and every eleventh curve lacks its last point."""
    points = bridge.curve_points(spark, sf_dir).where("NOT (curve_id % 11 = 3 AND idx = 63)")
    spaces = bridge.pairs(spark, sf_dir).select(F.col("fr_id").alias("workspace_id"), "fr_id", F.when(F.col("fr_id") % 7 != 0, F.col("target_id")).alias("target_id"))
    ready = curves.prepare(points, grids.grid_frame(spark, grids.evaluation_grid()), POINTS_PER_OCTAVE, cq.ANCHOR_HZ)
    own = bridge.filters(spark, sf_dir).join(spaces.select(F.col("workspace_id").alias("preset_id")), "preset_id", "left_semi")
    eq = ops.cascade(own, grids.grid_frame(spark, grids.evaluation_grid())).withColumnRenamed("preset_id", "workspace_id")
    return workspace.derive(spaces, points, ready, eq)


@query(with_views("first_of", "points", "segments", *CURVE_VIEWS[3:8], "filters", dsp.COEFS, _EQ, _SPACE) + f""", rows AS (
    SELECT workspace_id, a.idx, a.f, b.db - a.db - coalesce(eq.db, 0) AS db FROM states JOIN prepared AS a ON a.curve_id = fr_id JOIN prepared AS b ON b.curve_id = target_id AND b.idx = a.idx LEFT JOIN eq ON eq.preset_id = workspace_id AND eq.idx = a.idx WHERE status = 'ready'),
found AS (SELECT workspace_id, avg(abs(db)) AS mae, sqrt(avg(db * db)) AS rmse, max(abs(db)) AS max_abs FROM rows GROUP BY workspace_id)
SELECT workspace_id, status, {s6('mae')} AS mae, {s6('rmse')} AS rmse, {s6('max_abs')} AS max_abs FROM states LEFT JOIN found USING (workspace_id)""")
def w15_workspace_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _workspace(spark, sf_dir)[1]
    return states.select("workspace_id", "status", *[r6(c).alias(c) for c in ("mae", "rmse", "max_abs")])


@query(with_views("first_of", "points", "segments", *CURVE_VIEWS[3:8], "filters", dsp.COEFS, _EQ, _SPACE) + f"""
SELECT workspace_id, a.idx, round(a.db + coalesce(eq.db, 0), 4) + 0.0e0 AS result, round(b.db - a.db - coalesce(eq.db, 0), 4) + 0.0e0 AS residual
FROM states JOIN prepared AS a ON a.curve_id = fr_id JOIN prepared AS b ON b.curve_id = target_id AND b.idx = a.idx LEFT JOIN eq ON eq.preset_id = workspace_id AND eq.idx = a.idx WHERE status = 'ready' AND a.idx % 16 = 0""")
def w15_workspace_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixteenth place (six an octave), as a graph reads them."""
    rows = _workspace(spark, sf_dir)[0].where("idx % 16 = 0")
    return rows.select("workspace_id", "idx", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("result", "residual")])


@query(with_views("filters", dsp.GRID61, dsp.COEFS, dsp.LEVELS, dsp.CASCADE) + """, kinds AS (SELECT preset_id, CASE WHEN count(*) FILTER (enabled) <= 3 THEN 'solvable' ELSE 'stress' END AS category FROM filters GROUP BY preset_id)
SELECT preset_id AS case_id, category, idx, round(-db, 4) + 0.0e0 AS source, 0.0e0 AS target, round(db, 4) + 0.0e0 AS desired FROM cascade JOIN kinds USING (preset_id)""")
def s20_synthetic_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preset as a case on six places an octave; with more than three filters it is a stress case."""
    rows = runner.synthetic_cases(bridge.filters(spark, sf_dir), grids.grid_frame(spark, fq.COARSE), solvable=3, places=4)
    return rows.select("case_id", "category", "idx", "source", "target", "desired")


@query(with_views(*CURVE_VIEWS) + f"SELECT CAST(t.curve_id AS VARCHAR) AS case_id, t.idx, {s6('t.db - s.db')} AS db FROM prepared AS t JOIN prepared AS s ON s.idx = t.idx AND s.curve_id = (SELECT max(vec_id) FROM embeddings) WHERE t.curve_id IN (SELECT target_id FROM first_of)")
def s16_research_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last response against every target."""
    points = bridge.curve_points(spark, sf_dir)
    last = bridge.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    cases = runner.research_cases(points.where(F.col("curve_id") == last), points.where("kind = 'target'"), cq.ANCHOR_HZ)
    return cases.select(F.col("case_id").cast("string").alias("case_id"), "idx", r6("db").alias("db"))


_FILE_POINTS = """written AS (SELECT curve_id, label, kind, idx, round(f, 6) AS f, round(db, 6) AS db FROM points)"""


@query(with_views("first_of", "points", _FILE_POINTS, bridge.SQL["segments"].replace("FROM points", "FROM written"), *CURVE_VIEWS[3:7]) + "SELECT CAST(t.curve_id AS VARCHAR) AS case_id, t.idx, round(t.db - s.db, 5) + 0.0e0 AS db FROM prepared AS t JOIN prepared AS s ON s.idx = t.idx AND s.curve_id = (SELECT max(vec_id) FROM embeddings) WHERE t.curve_id IN (SELECT target_id FROM first_of)")
def s15_load_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last response and every target written as text files, one folder a curve, and loaded as the cases of a plan."""
    points = bridge.curve_points(spark, sf_dir)
    where = f"{shared_dir(spark)}/eqspark/cases/{uuid.uuid4().hex}"
    last = bridge.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    line = F.concat_ws("\t", F.col("f").cast("decimal(20,6)"), F.col("db").cast("decimal(20,6)"))
    texts = points.where((F.col("curve_id") == last) | (F.col("kind") == "target")).groupBy("curve_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("t")))).alias("x"))
    texts.select("curve_id", F.concat_ws("\n", F.transform("x", lambda v: v["t"])).alias("value")).write.partitionBy("curve_id").text(where)
    targets = [r.curve_id for r in points.where("kind = 'target'").select("curve_id").distinct().collect()]  # a label has one
    cases = runner.load_cases(spark, f"{where}/curve_id={last}", {str(t): f"{where}/curve_id={t}" for t in targets}, cq.ANCHOR_HZ)
    return cases.select("case_id", "idx", (F.round("db", 5) + F.lit(0.0)).alias("db"))


_STATES = """states AS (SELECT o_custkey, o_orderkey, o_orderstatus AS solution, CASE WHEN o_orderkey % 3 > 0 THEN 'manual' END AS provenance, [o_orderpriority] AS filters, o_orderkey % 5 AS fr FROM (SELECT o_custkey, o_orderkey, min(o_orderstatus) AS o_orderstatus, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey, o_orderkey))"""


@query(with_views(_STATES) + """SELECT o_orderkey, filters[1] AS first_filter, provenance, solution, fr,
    row_number() OVER w > 1 AND lag(filters) OVER w IS NOT DISTINCT FROM filters AND lag(provenance) OVER w IS NOT DISTINCT FROM provenance AND lag(solution) OVER w IS NOT DISTINCT FROM solution AS same FROM states WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def t12_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as states of a workspace: each one's snapshot, and whether it is the same to the history as the one before (T4)."""
    o = bridge.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderkey").agg(F.min("o_orderstatus").alias("s"), F.min("o_orderpriority").alias("p"))
    c = F.col
    state = F.struct(F.array("p").alias("filters"), F.when(c("o_orderkey") % 3 > 0, "manual").alias("filterProvenance"), c("s").alias("solutionState"), F.lit(None).cast("string").alias("autoEqRun"), (c("o_orderkey") % 5).alias("activeFrId"), F.lit(0).alias("activeTargetId"))
    rows = o.withColumn("now", recorder.snapshot(state)).withColumn("before", F.lag("now").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    same = F.coalesce(c("before").isNotNull() & recorder.same_state(c("before"), c("now")), F.lit(False))
    return rows.select("o_orderkey", c("now.filters")[0].alias("first_filter"), c("now.filterProvenance").alias("provenance"), c("now.solutionState").alias("solution"), c("now.activeFrId").alias("fr"), same.alias("same"))


@query()
def i52_research_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of the last response against every target, two budgets and two repeats, with verified metrics: its aggregates."""
    points = bridge.curve_points(spark, sf_dir)
    last = bridge.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    cases = runner.research_cases(points.where(F.col("curve_id") == last), points.where("kind = 'target'"), cq.ANCHOR_HZ)
    names = [str(r[0]) for r in cases.select("case_id").distinct().collect()]  # a plan's cases
    cells = research.research_cells(spark, names, [5, 15], [10])
    return runner.execute(cases, cells, repeats=2)["aggregates"].drop("reasons")


# --- presets -----------------------------------------------------------------------------------


@query(with_views("filters", dsp.GRID958, dsp.COEFS, dsp.PAIRS) + f""", own AS (SELECT preset_id, count(*) AS filter_count, greatest(max(q), 0) AS max_q, greatest(max(gain), 0) AS max_boost FROM filters WHERE enabled GROUP BY preset_id),
found AS (SELECT preset_id, count(*) FILTER (score >= 0.35 AND score < 0.65) AS moderate, count(*) FILTER (score >= 0.65) AS strong FROM pairs GROUP BY preset_id)
SELECT p.preset_id, coalesce(filter_count, 0) AS filter_count, coalesce(max_q, 0.0) AS max_q, coalesce(max_boost, 0.0) AS max_boost, coalesce(moderate, 0) AS moderate, coalesce(strong, 0) AS strong FROM (SELECT DISTINCT preset_id FROM filters) AS p LEFT JOIN own USING (preset_id) LEFT JOIN found USING (preset_id)""")
def a20_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.filters(spark, sf_dir)
    on = rows.where("enabled")
    return ops.result_rows(rows.select("preset_id").distinct(), on, presets.cancellations(presets.packed(on), fq.FULL))


_MOVES = "moves AS (SELECT preset_id, CAST(preset_id % 5 AS INTEGER) AS here, preset_id % 2 = 0 AS up, max(ordinal) AS last FROM filters GROUP BY preset_id)"


@query(with_views("filters", _MOVES) + """, t AS (SELECT preset_id, here, CASE WHEN up THEN here - 1 ELSE here + 1 END AS other, last FROM moves)
SELECT preset_id, f, gain, CAST(CASE WHEN here > last OR other < 0 OR other > last THEN ordinal WHEN ordinal = here THEN other WHEN ordinal = other THEN here ELSE ordinal END AS INTEGER) AS ordinal FROM filters JOIN t USING (preset_id)""")
def o24_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One move in each preset, some of them beyond its ends."""
    rows = bridge.filters(spark, sf_dir)
    moves = rows.select("preset_id").distinct().select("preset_id", (F.col("preset_id") % 5).cast("int").alias("ordinal"), (F.col("preset_id") % 2 == 0).alias("up"))
    return ops.reorder(rows, moves).select("preset_id", "f", "gain", "ordinal")


@query(with_views("filters") + "SELECT preset_id, ordinal, CAST(row_number() OVER (PARTITION BY preset_id ORDER BY CASE type WHEN 'LS' THEN 0 WHEN 'PK' THEN 1 ELSE 2 END, f, concat('f-', ordinal)) AS INTEGER) AS place FROM filters")
def o19_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = bridge.filters(spark, sf_dir).withColumn("id", F.concat(F.lit("f-"), F.col("ordinal")))
    return ops.canonical_places(named).select("preset_id", "ordinal", "place")


@query(with_views("filters") + "SELECT preset_id, count(*) AS n, bool_and(f BETWEEN 20 AND 20000 AND gain BETWEEN -15 AND 15 AND q BETWEEN 0.1 AND 12) AND count(*) <= 64 AND bool_and(preset_id % 9 <> 0 OR ordinal <> 1) AND (preset_id % 4 <> 0 OR count(*) = 1) AS ok FROM filters GROUP BY preset_id")
def p14_valid_named_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters with ids: every fourth preset repeats one, and every ninth has a blank one."""
    name = F.when((F.col("preset_id") % 9 == 0) & (F.col("ordinal") == 1), " ").when(F.col("preset_id") % 4 == 0, "f").otherwise(F.concat(F.lit("f-"), F.col("ordinal")))
    return ops.valid_presets(bridge.filters(spark, sf_dir).withColumn("id", name))


# --- texts -------------------------------------------------------------------------------------

_BARE = f"concat('\"enabled\":', CAST(enabled AS VARCHAR), ',\"type\":\"', type, '\",\"frequencyHz\":', {js('f')}, ',\"gainDb\":', {js('gain')}, ',\"q\":', {js('q')}, '}}')"
_TRACE = f"concat('[', CAST(enabled AS VARCHAR), ',\"', type, '\",', {js('f')}, ',', {js('gain')}, ',', {js('q')}, ']')"
_KEY_ORDER = "CASE type WHEN 'LS' THEN 0 WHEN 'PK' THEN 1 ELSE 2 END, f, gain, q, enabled"


@query(with_views("filters") + f"""SELECT preset_id,
    sha256(concat('[', string_agg(concat('{{"id":"f-', ordinal, '",', {_BARE}), ',' ORDER BY {_KEY_ORDER}, concat('f-', ordinal)), ']')) AS filter_key,
    sha256(concat('[', string_agg(concat('{{', {_BARE}), ',' ORDER BY {_KEY_ORDER}), ']')) AS semantic_key,
    sha256(concat('{{"mutation":"split","filters":[', string_agg(concat('{{', {_BARE}), ',' ORDER BY ordinal), ']}}')) AS proposal_key,
    sha256(concat('[', string_agg(concat('"', replace({_TRACE}, '"', '\\"'), '"'), ',' ORDER BY ordinal), ']')) AS solution_key
FROM filters GROUP BY preset_id""")
def d6_filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 to D11: hashes of the texts of each preset."""
    x = F.col("filters")
    digest = lambda c: F.sha2(c, 256)
    return keys.gathered(bridge.filters(spark, sf_dir)).select("preset_id", digest(keys.filter_key(x)).alias("filter_key"), digest(keys.filter_key(x, False)).alias("semantic_key"), digest(keys.proposal_key(F.lit("split"), x)).alias("proposal_key"), digest(keys.solution_key(x)).alias("solution_key"))


@query(with_views("filters") + "SELECT preset_id, string_agg(CASE k WHEN 1 THEN type ELSE concat(type, '-', k - 1) END, ' ' ORDER BY ordinal) AS names FROM (SELECT *, row_number() OVER (PARTITION BY preset_id, type ORDER BY ordinal) AS k FROM filters) GROUP BY preset_id")
def d12_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that all wish to be called by their type."""
    return keys.gathered(bridge.filters(spark, sf_dir)).select("preset_id", F.array_join(keys.unique_names(F.transform("filters", lambda x: x["type"])), " ").alias("names"))


@query(with_views("first_of", "points", "pairs AS (SELECT vec_id AS fr_id, target_id FROM embeddings JOIN first_of USING (label) WHERE vec_id <> target_id)") + f""", texts AS (SELECT curve_id, concat('[', string_agg(concat('[', {js('f')}, ',', {js('round(db, 6)')}, ']'), ',' ORDER BY f), ']') AS t FROM points GROUP BY curve_id)
SELECT fr_id, sha256(concat('{{"activeFrId":"', fr_id, '","activeTargetId":"', target_id, '","sourcePoints":', s.t, ',"targetPoints":', t.t, ',"normalization":["hz",500,60],"settings":[20,20000,-15,15,0.1,12,10,', CASE fr_id % 3 WHEN 0 THEN 30 ELSE 60 END, ']}}')) AS signature
FROM pairs JOIN texts AS s ON s.curve_id = fr_id JOIN texts AS t ON t.curve_id = target_id""")
def f45_run_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs of every pair's run; every third pair has another time limit."""
    points = bridge.curve_points(spark, sf_dir).groupBy("curve_id").agg(F.sort_array(F.collect_list(F.struct("f", F.round("db", 6).alias("db")))).alias("p"))
    side = lambda name: points.select(F.col("curve_id").alias(name), F.col("p").alias(f"{name}_points"))
    met = bridge.pairs(spark, sf_dir).join(side("fr_id"), "fr_id").join(side("target_id"), "target_id")
    d = lambda x: F.lit(float(x))
    settings = [d(20), d(20000), d(-15), d(15), d(0.1), d(12), d(10), F.when(F.col("fr_id") % 3 == 0, 30.0).otherwise(60.0)]
    whole = keys.input_signature(F.col("fr_id").cast("string"), F.col("target_id").cast("string"), F.col("fr_id_points"), F.col("target_id_points"), [F.lit("hz"), d(500), d(60)], settings)
    return met.select("fr_id", F.sha2(whole, 256).alias("signature"))


_SHORT = lambda x, n: f"regexp_replace(regexp_replace(printf('%.{n}f', {x}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


@query(with_views("filters") + f"""SELECT preset_id, ordinal,
    CASE WHEN f < 1000 THEN concat({js('f')}, ' Hz') ELSE concat({_SHORT('f / 1000', 1)}, 'k Hz') END AS snapshot_hz, concat(CASE WHEN gain >= 0 THEN '+' ELSE '' END, printf('%.1f', gain), ' dB') AS snapshot_db,
    CASE WHEN f >= 1000 THEN printf('%.2f kHz', f / 1000) ELSE printf('%.0f Hz', f) END AS graph_hz, CASE WHEN f = 20 THEN '20Hz' WHEN f = 20000 THEN '20kHz' WHEN f >= 1000 THEN concat({js('(f / 1000)')}, 'k') ELSE {js('f')} END AS tick,
    printf('%.2f dB', gain) AS shown_db, CASE WHEN f >= 1000 THEN concat({_SHORT('f / 1000', 2)}, ' kHz') ELSE concat({_SHORT('f', 2)}, ' Hz') END AS shown_hz FROM filters""")
def f38_display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F39 to F42 and F44 of every filter."""
    f, gain = F.col("f"), F.col("gain")
    return bridge.filters(spark, sf_dir).withColumn("gain", gain + 0.0).select("preset_id", "ordinal", text.snapshot_frequency(f).alias("snapshot_hz"), text.snapshot_gain(gain).alias("snapshot_db"), text.graph_frequency(f).alias("graph_hz"), text.graph_tick(f).alias("tick"), text.display_db(gain).alias("shown_db"), text.display_frequency(f).alias("shown_hz"))


@query(with_views("filters") + f""", first AS (SELECT * FROM filters WHERE ordinal = 0), n AS (SELECT preset_id, count(*) - 1 AS more FROM filters GROUP BY preset_id)
SELECT preset_id, concat(type, ' ', CASE WHEN f < 1000 THEN concat({js('f')}, ' Hz') ELSE concat({_SHORT('f / 1000', 1)}, 'k Hz') END, ' ', CASE WHEN gain >= 0 THEN '+' ELSE '' END, printf('%.1f', gain), ' dB', CASE WHEN more > 0 THEN concat(' +', more) ELSE '' END, ', preamp -6.0 dB') AS summary FROM first JOIN n USING (preset_id)""")
def f38_snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.filters(spark, sf_dir).withColumn("gain", F.col("gain") + 0.0)
    return keys.gathered(rows).select("preset_id", text.snapshot_summary(F.col("filters"), F.lit(-6.0)).alias("summary"))


@query("""SELECT p_partkey, CAST(p_partkey % 4 AS INTEGER) AS depth, CASE p_partkey % 3 WHEN 0 THEN 'LS' WHEN 1 THEN 'HS' ELSE 'PK' END AS kind,
    CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN p_brand ELSE 'the fit failed' END AS message FROM part""")
def f25_small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25, F36 and F47 of texts made from parts."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("struct-add-pk"), F.expr("repeat('-split-low', cast(p_partkey % 4 as int))"))
    long = F.when(k % 3 == 0, "LSQ").when(k % 3 == 1, "HSQ").otherwise("PK")
    category = F.element_at(F.array(*[F.lit(c) for c in ("validation", "optimization", "numeric", "parse", "export", "internal")]), (k % 6 + 1).cast("int"))
    return bridge.table(spark, sf_dir, "part").select("p_partkey", text.split_depth(name).alias("depth"), text.from_long_type(long).alias("kind"), text.public_error(category, F.col("p_brand")).alias("message"))


# --- rules -------------------------------------------------------------------------------------

_SETTINGS = """settings AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 10e0 ELSE 20e0 END AS lo, CASE p_partkey % 13 WHEN 0 THEN 20e0 ELSE 20000e0 END AS hi, CASE p_partkey % 17 WHEN 0 THEN 20e0 ELSE 15e0 END AS gain,
    CAST(p_partkey % 70 AS DOUBLE) + CASE p_partkey % 19 WHEN 0 THEN 0.5e0 ELSE 0e0 END AS n, CASE p_partkey % 4 WHEN 0 THEN 60e0 WHEN 1 THEN 5e0 WHEN 2 THEN 61e0 END AS t FROM part)"""


def _settings(k: Column) -> Column:
    """Settings by a number, some of them broken."""
    return F.struct(
        F.when(k % 11 == 0, 10.0).otherwise(20.0).alias("minFrequencyHz"), F.when(k % 13 == 0, 20.0).otherwise(20000.0).alias("maxFrequencyHz"), F.lit(-15.0).alias("minGainDb"), F.when(k % 17 == 0, 20.0).otherwise(15.0).alias("maxGainDb"),
        F.lit(0.1).alias("minQ"), F.lit(12.0).alias("maxQ"), ((k % 70).cast("double") + F.when(k % 19 == 0, 0.5).otherwise(0.0)).alias("maxFilters"), F.when(k % 4 == 0, 60.0).when(k % 4 == 1, 5.0).when(k % 4 == 2, 61.0).alias("timeLimitSeconds"),
    )


_UNTIMED = "lo >= 20 AND hi <= 20000 AND lo < hi AND gain <= 15 AND n = floor(n) AND n <= 64"


@query(with_views(_SETTINGS) + f"SELECT p_partkey, {_UNTIMED} AS untimed, {_UNTIMED} AND coalesce(t IN (5, 15, 30, 60, 120), FALSE) AS ok, lo = 20 AND hi = 20000 AND gain = 15 AND n = 10 AS eligible FROM settings")
def p12_valid_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P13 and P18 of settings made from parts."""
    rows = bridge.table(spark, sf_dir, "part").select("p_partkey", _settings(F.col("p_partkey")).alias("s"))
    s = F.col("s")
    return rows.select("p_partkey", session.valid_settings(s, timed=False).alias("untimed"), F.coalesce(session.valid_settings(s), F.lit(False)).alias("ok"), acceptance.structural_eligible(s).alias("eligible"))


@query(with_views("first_of", "points") + "SELECT curve_id, bool_and(f > 0 AND f < 8000e0 * (1 + curve_id % 3)) AS ok FROM points GROUP BY curve_id")
def p11_valid_response_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves at one of three rates."""
    rows = bridge.curve_points(spark, sf_dir).groupBy("curve_id").agg(F.collect_list("f").alias("f"))  # a curve's places
    ok = F.when(F.col("curve_id") % 3 == 0, acceptance.valid_response_input(F.col("f"), 16_000.0)).when(F.col("curve_id") % 3 == 1, acceptance.valid_response_input(F.col("f"), 32_000.0)).otherwise(acceptance.valid_response_input(F.col("f"), 48_000.0))
    return rows.select("curve_id", ok.alias("ok"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results with their manifests and the inputs that were taken; a remainder of the key breaks one part."""
    k = F.col("o_orderkey")
    f = lambda i, g: F.struct(F.concat(F.lit("f"), F.lit(i)).alias("id"), F.lit(True).alias("enabled"), F.lit("PK").alias("type"), F.lit(1000.0 + i).alias("frequencyHz"), g.alias("gainDb"), F.lit(1.0).alias("q"))
    own = F.array(f(1, F.lit(3.0)), F.when(k % 6 == 1, f(1, F.lit(2.0))).otherwise(f(2, F.lit(2.0))))
    said = F.when(k % 6 == 2, F.array(f(1, F.lit(4.0)), f(2, F.lit(2.0)))).otherwise(own)
    measured = F.struct(F.lit(0.1).alias("maeDb"), F.lit(0.2).alias("rmseDb"), F.lit(0.5).alias("maxAbsDb"), F.lit(100.0).alias("maxAbsFrequencyHz"))
    settings = lambda n, t: F.struct(F.lit(20.0).alias("minFrequencyHz"), F.lit(20000.0).alias("maxFrequencyHz"), F.lit(-15.0).alias("minGainDb"), F.lit(15.0).alias("maxGainDb"), F.lit(0.1).alias("minQ"), F.lit(12.0).alias("maxQ"), n.alias("maxFilters"), t.alias("timeLimitSeconds"))
    norm = lambda mode: F.struct(mode.alias("mode"), F.lit(500.0).alias("frequencyHz"), F.lit(60.0).alias("levelDb"))
    marker = F.when(k % 3 == 0, F.struct(F.lit(acceptance.STRUCTURAL[0]).alias("preset"), F.lit(acceptance.STRUCTURAL[1]).alias("seedMode")))
    manifest = F.struct(
        F.lit(3).alias("schemaVersion"), F.lit("standard-v2").alias("algorithmVersion"), F.lit(48000.0).alias("sampleRateHz"), settings(F.when(k % 6 == 3, 1.0).otherwise(10.0), F.lit(60.0)).alias("autoeqSettings"), norm(F.lit("hz")).alias("normalization"),
        F.lit("a").alias("sourceName"), F.lit("b").alias("targetName"), said.alias("finalFilters"), measured.alias("metrics"), F.lit(-3.0).alias("preampDb"), F.lit(True).alias("targetAchieved"), F.when(k % 6 == 4, "gave-up").otherwise("converged").alias("terminationReason"), marker.alias("experimental"),
    )
    result = F.struct(own.alias("filters"), measured.alias("metrics"), F.when(k % 6 == 5, -4.0).otherwise(-3.0).alias("preampDb"), manifest.alias("manifest"))
    taken = F.struct(F.when(k % 5 == 1, "x").otherwise("a").alias("sourceName"), F.lit("b").alias("targetName"), norm(F.when(k % 5 == 2, "db").otherwise("hz")).alias("normalization"), settings(F.when(k % 6 == 3, 1.0).otherwise(10.0), F.when(k % 5 == 3, 5.0).otherwise(60.0)).alias("settings"))
    return bridge.table(spark, sf_dir, "orders").select("o_orderkey", result.alias("result"), taken.alias("taken"), (k % 2 == 0).alias("structural"))


@query("""SELECT o_orderkey, o_orderkey % 6 = 0 AS valid, o_orderkey % 5 IN (0, 4) AND (o_orderkey % 3 = 0) = (o_orderkey % 2 = 0) AS captured, o_orderkey % 5 <> 2 AS same_level, o_orderkey % 5 <> 3 AS same_settings, o_orderkey % 6 <> 2 AS same_filters FROM orders""")
def p16_accepted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, P16, P26 and P34 to P36 of results made from orders."""
    m = F.col("result.manifest")
    return _runs(spark, sf_dir).select(
        "o_orderkey", acceptance.valid_result(F.col("result"), session.valid_manifest(m)).alias("valid"), acceptance.matches_captured(m, F.col("taken"), F.col("structural")).alias("captured"),
        acceptance.same_normalization(m["normalization"], F.col("taken.normalization")).alias("same_level"), acceptance.same_settings(m["autoeqSettings"], F.col("taken.settings")).alias("same_settings"),
        acceptance.same_filters(F.col("result.filters"), m["finalFilters"]).alias("same_filters"),
    )


@query("SELECT c_custkey, c_custkey % 8 <> 1 AND c_custkey % 8 <> 2 AS same_corpus, c_custkey % 8 IN (0, 6, 7) AS compatible FROM customer")
def p40_compatible_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P39 and P40 of baselines made from customers, of which a remainder breaks one part."""
    k = F.col("c_custkey")
    expected = F.create_map(F.lit("a"), F.lit("11"), F.lit("b"), F.lit("22"))
    hashes = F.when(k % 8 == 1, F.create_map(F.lit("a"), F.lit("11"))).when(k % 8 == 2, F.create_map(F.lit("a"), F.lit("11"), F.lit("b"), F.lit("23"))).otherwise(F.create_map(F.lit("b"), F.lit("22"), F.lit("a"), F.lit("11")))
    identity = F.struct(F.when(k % 8 == 3, 2).otherwise(1).alias("schemaVersion"), F.when(k % 8 == 4, "").otherwise("c").alias("implementationCommit"), F.when(k % 8 == 5, 9).otherwise(3).alias("runnerSchemaVersion"), hashes.alias("corpusHashes"))
    rows = bridge.table(spark, sf_dir, "customer").select("c_custkey", identity.alias("i"))
    return rows.select("c_custkey", acceptance.same_hashes(F.col("i.corpusHashes"), expected).alias("same_corpus"), acceptance.compatible_baseline(F.col("i"), expected, {"runnerSchemaVersion": 3}, F.array(F.lit(1))).alias("compatible"))


# --- sessions ----------------------------------------------------------------------------------

#: What is broken in a customer's session, by the remainder of its key, and the error that it must have.
BROKEN = {2: "unsupported version", 3: "invalid settings", 4: "malformed curve", 5: "duplicate curve ids", 6: "the active response is no response curve", 7: "invalid normalization", 8: "malformed filter", 9: "fitted provenance needs a run", 10: "settings differ from the run", 11: "not a session document", 12: "filters without provenance", 13: "duplicate filter ids"}
KINDS = 14


def _session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, text: a session for each customer; remainders 0 (manual) and 1 (fitted) are sound."""
    k = F.col("c_custkey") % KINDS
    fitted = k.isin(1, 9, 10)
    point = lambda f, db: F.struct(F.lit(f).alias("frequencyHz"), db.alias("db"))
    level = F.round(F.col("c_acctbal").cast("double"), 2)
    curve = lambda name, kind, points: F.struct(name.alias("id"), F.col("c_name").alias("name"), F.lit(kind).alias("kind"), points.alias("rawPoints"), F.create_map(F.lit("from"), F.col("c_mktsegment")).alias("metadata"))
    one = curve(F.lit("a"), "fr", F.when(k == 4, F.array(point(20000.0, level), point(20.0, level))).otherwise(F.array(point(20.0, level), point(20000.0, level))))
    two = curve(F.when(k == 5, "a").otherwise("b"), "target", F.array(point(20.0, F.lit(0.0)), point(20000.0, F.lit(0.0))))
    settings = lambda most: F.struct(F.lit(20.0).alias("minFrequencyHz"), F.lit(20000.0).alias("maxFrequencyHz"), F.lit(-15.0).alias("minGainDb"), F.lit(15.0).alias("maxGainDb"), F.when(k == 3, 13.0).otherwise(0.1).alias("minQ"), F.lit(12.0).alias("maxQ"), most.alias("maxFilters"), F.lit(60.0).alias("timeLimitSeconds"))
    norm = F.struct(F.lit("hz").alias("mode"), F.lit(500.0).alias("frequencyHz"), F.when(k == 7, 200.0).otherwise(60.0).alias("levelDb"))
    f = lambda i: F.struct(i.alias("id"), F.lit(True).alias("enabled"), F.lit("PK").alias("type"), F.lit(1000.0).alias("frequencyHz"), F.lit(3.0).alias("gainDb"), F.when(k == 8, 99.0).otherwise(1.0).alias("q"))
    own = F.array(f(F.lit("f1")), f(F.when(k == 13, "f1").otherwise("f2")))
    measured = F.struct(F.lit(0.1).alias("maeDb"), F.lit(0.2).alias("rmseDb"), F.lit(0.5).alias("maxAbsDb"), F.lit(100.0).alias("maxAbsFrequencyHz"))
    manifest = F.struct(F.lit(3).alias("schemaVersion"), F.lit(48000.0).alias("sampleRateHz"), settings(F.lit(10.0)).alias("autoeqSettings"), norm.alias("normalization"), own.alias("finalFilters"), measured.alias("metrics"), F.lit(-3.0).alias("preampDb"), F.lit(True).alias("targetAchieved"), F.lit("target-reached").alias("terminationReason"))
    whole = F.struct(
        F.when(k == 2, 9).otherwise(2).alias("schemaVersion"), F.array(one, two).alias("curves"), F.when(k == 6, "b").otherwise("a").alias("activeFrId"), F.when(k != 5, "b").alias("activeTargetId"), norm.alias("normalization"), settings(F.when(k == 10, 12.0).otherwise(10.0)).alias("autoeqSettings"),
        own.alias("filters"), F.when(fitted, session.FITTED).when(k != 12, "manual").alias("filterProvenance"), F.lit("clean").alias("solutionState"), F.when(fitted & (k != 9), F.struct(manifest.alias("manifest"))).alias("autoEqRun"),
    )
    return bridge.table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 11, "no json").otherwise(F.to_json(whole)).alias("text"))


_ERRORS = "CASE c_custkey % 14 " + " ".join(f"WHEN {n} THEN '{e}'" for n, e in BROKEN.items()) + " END"


@query(f"SELECT c_custkey, {_ERRORS} AS error, CASE WHEN c_custkey % 14 < 2 THEN 2 END AS n_filters, CASE WHEN c_custkey % 14 < 2 THEN CASE c_custkey % 14 WHEN 1 THEN 'autoeq' ELSE 'manual' END END AS provenance FROM customer")
def s14_read_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of customers read and checked; every rule's error is in some."""
    read = session.read_sessions(_session_texts(spark, sf_dir), "c_custkey")
    return read.select("c_custkey", "error", F.when(F.col("session").isNotNull(), F.size("session.filters")).alias("n_filters"), F.col("session.filterProvenance").alias("provenance"))


@query("SELECT c_custkey, TRUE AS stable, round(CAST(c_acctbal AS DOUBLE), 2) AS first_db FROM customer WHERE c_custkey % 14 < 2")
def k11_write_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound sessions written, read and written again: whether the texts agree, and the first level of the response curve."""
    once = session.write_sessions(session.read_sessions(_session_texts(spark, sf_dir), "c_custkey"), "c_custkey")
    again = session.read_sessions(once, "c_custkey")
    twice = session.write_sessions(again, "c_custkey").withColumnRenamed("text", "second")
    first = again.select("c_custkey", F.col("session.curves")[0]["rawPoints"][0]["db"].alias("first_db"))
    return once.join(twice, "c_custkey").join(first, "c_custkey").select("c_custkey", (F.col("text") == F.col("second")).alias("stable"), "first_db")


# --- change and runs ---------------------------------------------------------------------------


@query("""WITH i AS (SELECT o_custkey, arg_max(s, o_orderkey) AS now FROM (SELECT o_custkey, o_orderkey, min(o_orderstatus) AS s FROM orders GROUP BY o_custkey, o_orderkey) GROUP BY o_custkey)
SELECT c_custkey AS run_id, coalesce(now = 'O' AND c_custkey % 4 <> 0, FALSE) AS applied FROM customer LEFT JOIN i ON o_custkey = c_custkey""")
def t7_apply_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the signature of open orders against each customer's latest order; every fourth run is no longer active."""
    o = bridge.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderkey").agg(F.min("o_orderstatus").alias("signature"))
    inputs = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("version"), "signature", (F.col("o_custkey") % 4 != 0).alias("active"))
    results = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("O").alias("signature"))
    return recorder.apply_fresh(results, inputs).select("run_id", "applied")


_RUN_EVENTS = "e AS (SELECT user_id AS key, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'progress' WHEN 2 THEN 'finish' WHEN 3 THEN 'fail' ELSE 'cancel' END AS event, CAST(event_id // 400 AS VARCHAR) AS run_id FROM events)"


@query(with_views(_RUN_EVENTS) + """, s AS (SELECT *, max(CASE WHEN event = 'start' THEN seq END) OVER (PARTITION BY key ORDER BY seq) AS at FROM e)
SELECT s.key, s.seq, CASE WHEN s.at IS NULL THEN 'idle' ELSE coalesce((SELECT CASE x.event WHEN 'fail' THEN 'error' ELSE 'idle' END FROM e AS x JOIN e AS b ON b.key = x.key AND b.seq = s.at WHERE x.key = s.key AND x.seq > s.at AND x.seq <= s.seq AND x.run_id = b.run_id AND x.event IN ('finish', 'fail', 'cancel') ORDER BY x.seq LIMIT 1), 'running') END AS state FROM s""")
def t8_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as starts and ends of runs."""
    k = F.col("event_id")
    event = F.element_at(F.array(*[F.lit(x) for x in ("start", "progress", "finish", "fail", "cancel")]), (k % 5 + 1).cast("int"))
    rows = bridge.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), k.alias("seq"), event.alias("event"), F.expr("cast(event_id div 400 as string)").alias("run_id"))
    return recorder.run_states(rows).select("key", "seq", "state")


@query("""WITH RECURSIVE e AS (
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_type AS value, ['edit', 'edit', 'undo', 'edit', 'undo', 'redo', 'replace'][event_id % 7 + 1] AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
log AS (
    SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS present, CAST([] AS VARCHAR[]) AS past, CAST([] AS VARCHAR[]) AS future FROM (SELECT DISTINCT key FROM e)
    UNION ALL
    SELECT l.key, e.n, e.seq,
           CASE WHEN op IN ('edit', 'replace') THEN value WHEN op = 'undo' AND len(past) > 0 THEN past[len(past)] WHEN op = 'redo' AND len(future) > 0 THEN future[len(future)] ELSE present END,
           CASE WHEN op = 'edit' AND value IS DISTINCT FROM present OR op = 'redo' AND len(future) > 0 THEN list_append(past, present) WHEN op = 'undo' THEN past[1:len(past) - 1] ELSE past END,
           CASE WHEN op = 'edit' AND value IS DISTINCT FROM present OR op = 'replace' THEN [] WHEN op = 'undo' AND len(past) > 0 THEN list_append(future, present) WHEN op = 'redo' THEN future[1:len(future) - 1] ELSE future END
    FROM log AS l JOIN e ON e.key = l.key AND e.n = l.n + 1)
SELECT key, seq, present, len(past) AS undoable, len(future) AS redoable FROM log WHERE n > 0""")
def t10_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as edits, undos and redos."""
    k = F.col("event_id")
    op = F.element_at(F.array(*[F.lit(x) for x in ("edit", "edit", "undo", "edit", "undo", "redo", "replace")]), (k % 7 + 1).cast("int"))
    return recorder.edit_states(bridge.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), k.alias("seq"), op.alias("op"), F.col("event_type").alias("value")))


_SOLUTION = "CASE o_orderstatus WHEN 'F' THEN 'fitted' WHEN 'O' THEN 'modified' ELSE 'stale' END"


@query(f"""WITH s AS (SELECT o_orderkey, {_SOLUTION} AS s, o_custkey % 3 AS a, o_custkey % 2 AS b FROM orders)
SELECT o_orderkey, CASE WHEN s IN ('fitted', 'stale') THEN 'modified' ELSE s END AS edited, CASE s WHEN 'fitted' THEN 'stale' ELSE s END AS renormalized, CASE WHEN s = 'fitted' AND NOT (a = 0 AND b = 1) THEN 'stale' ELSE s END AS restored FROM s""")
def t11_solution_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of orders after an edit, after another normalization, and when restored beside other active curves."""
    s = F.when(F.col("o_orderstatus") == "F", "fitted").when(F.col("o_orderstatus") == "O", "modified").otherwise("stale")
    rows = bridge.table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"), (F.col("o_custkey") % 3).alias("a"), (F.col("o_custkey") % 2).alias("b"))
    return rows.select("o_orderkey", recorder.after_edit(F.col("s")).alias("edited"), recorder.after_normalization(F.col("s")).alias("renormalized"), recorder.restored(F.col("s"), F.col("a"), F.col("b"), F.lit(0), F.lit(1)).alias("restored"))


@query("""SELECT user_id AS cell, event_type AS name, CAST(CASE event_type WHEN 'view' THEN greatest(max(event_id % 100), 0) ELSE sum(event_id % 100) END AS BIGINT) AS n FROM events GROUP BY user_id, event_type""")
def a22_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as counters of each user; views count as a peak, the others as sums."""
    rows = bridge.table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("name"), (F.col("event_id") % 100).alias("n"))
    return research.telemetry(rows, ["cell"], ("view",)).select("cell", F.explode("counters").alias("name", "n"))


@query(with_views("checkpoints") + """, m AS (SELECT cell, event_id, (greatest(rmse / 0.25e0, max_abs / 0.75e0), rmse, max_abs) AS m FROM checkpoints)
SELECT cell, event_id AS seq FROM (SELECT *, min(m) OVER (PARTITION BY cell ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m) WHERE best IS NULL OR m < best""")
def a22_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints that telemetry keeps: each better than the one kept before it."""
    return research.improving_checkpoints(bridge.checkpoints(spark, sf_dir).withColumnRenamed("event_id", "seq"), ["cell"]).select("cell", "seq")
