"""Queries over grids and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curves, features, fits, grids, pairs, smoothing
from ..operators.fitting import loudness
from ..operators.loudness import flat_field
from ..operators.sides import small_side
from ..schema import METRIC_BANDS, POINTS_PER_OCTAVE, RESEARCH_BANDS, ZOOM_RANGES, Normalization
from ..sources import bridge
from ..sources.bridge import grid_sql
from .registry import query, with_views

ANCHOR_HZ = 500.0
GRID = grids.evaluation_grid()


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def s6(e: str) -> str:
    return f"round({e}, 6) + 0.0e0"


GRID958 = grid_sql("grid", 958, "20e0 * power(2e0, idx / 96e0)", 20_000.0)
def placed_sql(name: str, grid: str, n: int, per_octave: int) -> str:
    """Segments at the places of a grid that they hold; a segment knows its places by arithmetic."""
    return f"""{name} AS MATERIALIZED (
    SELECT s.curve_id, g.idx, g.f, CASE WHEN g.f = l THEN ldb WHEN g.f = r THEN rdb ELSE ldb + ln(g.f / l) / ln(r / l) * (rdb - ldb) END AS db
    FROM (SELECT *, unnest(range(greatest(0, CAST(floor(log2(l / 20e0) * {per_octave}) AS BIGINT) - 1), least({n}, CAST(ceil(log2(r / 20e0) * {per_octave}) AS BIGINT) + 2))) AS place FROM segments WHERE r IS NOT NULL) AS s
    JOIN {grid} AS g ON g.idx = s.place AND g.f >= l AND (g.f < r OR (is_last AND g.f = r)))"""


AT, AT_480, AT_958 = placed_sql("placed", "grid", 958, 96), placed_sql("placed", "grid", 480, 48), placed_sql("placed958", "grid958", 958, 96)
OFFSETS = f"offsets AS (SELECT curve_id, -(ldb + ln({ANCHOR_HZ}e0 / l) / ln(r / l) * (rdb - ldb)) AS offset_db FROM segments WHERE {ANCHOR_HZ}e0 >= l AND {ANCHOR_HZ}e0 < r)"
PREPARED = "prepared AS MATERIALIZED (SELECT curve_id, idx, f, db + offset_db AS db FROM placed JOIN offsets USING (curve_id))"
PAIRS = "pairs AS (SELECT vec_id AS fr_id, target_id FROM embeddings JOIN first_of USING (label) WHERE vec_id <> target_id)"
WANTED = "wanted AS (SELECT fr_id AS pair_id, a.idx, a.f, b.db - a.db AS db FROM pairs JOIN prepared AS a ON a.curve_id = fr_id JOIN prepared AS b ON b.curve_id = target_id AND b.idx = a.idx)"
GRID480 = grid_sql("grid", 480, "20e0 * power(2e0, idx / 48e0)", 20_000.0)
GRID958_AS = grid_sql("grid958", 958, "20e0 * power(2e0, idx / 96e0)", 20_000.0)
CURVE_VIEWS = ("first_of", "points", "segments", GRID958, AT, OFFSETS, PREPARED, PAIRS, WANTED)
ERRORS = f"{s6('avg(abs(db))')} AS mae, {s6('sqrt(avg(db * db))')} AS rmse, {s6('max(abs(db))')} AS max_abs, {s6('arg_max(f, (abs(db), -idx))')} AS max_abs_hz"


def _grid(spark: SparkSession) -> DataFrame:
    return grids.grid_frame(spark, grids.evaluation_grid())


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = bridge.curve_points(spark, sf_dir)
    return curves.prepare(points, _grid(spark), POINTS_PER_OCTAVE, ANCHOR_HZ)


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, idx, f, db: each pair's target minus source, both normalized.

    The targets, one a label, are prepared alone and met by (label, place); their rows are known beforehand, so they are broadcast while they are few.
    Sources stay where their curve's points met, from the interpolation to whatever is grouped by pair.
    """
    points = bridge.curve_points(spark, sf_dir)
    grid = _grid(spark)
    side = lambda kind: curves.prepare(points.where(F.col("kind") == kind), grid, POINTS_PER_OCTAVE, ANCHOR_HZ, carry=("label",))
    n_labels = bridge.table(spark, sf_dir, "embeddings").select("label").distinct().count()
    targets = small_side(side("target").select("label", "idx", F.col("db").alias("target_db")), n_labels * len(grids.evaluation_grid()))
    met = side("fr").join(targets, ["label", "idx"])
    return met.select(F.col("curve_id").alias("pair_id"), "idx", "f", (F.col("target_db") - F.col("db")).alias("db"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, mae, rmse, max_abs, max_abs_hz of each wanted correction."""
    return pairs.error_metrics(bridge.curve_pairs(spark, sf_dir), GRID, ANCHOR_HZ)


def _rounded_errors(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in ("mae", "rmse", "max_abs", "max_abs_hz")})


def _plain_grid(f: list[float], name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grids.grid_frame(spark, f).select("idx", r6("f").alias("f"))

    run.__name__ = name
    return run


for _name, _f, _sql in (
    ("g2_evaluation_grid", grids.evaluation_grid(), grid_sql("g", 958, "20e0 * power(2e0, idx / 96e0)", 20_000.0)),
    ("g3_loudness_grid", grids.loudness_grid(), grid_sql("g", 480, "20e0 * power(2e0, idx / 48e0)", 20_000.0)),
    ("g4_preamp_grid", grids.dense_grid(), grid_sql("g", 16_384, "20e0 * power(1000e0, idx / 16383e0)", 20_000.0)),
    ("g5_raw_frequencies", grids.raw_frequencies(), grid_sql("g", 963, "20e0 * power(1.0072e0, idx)")),
):
    query(f"WITH {_sql} SELECT idx, {s6('f')} AS f FROM g")(_plain_grid(_f, _name))


@query("SELECT DISTINCT CAST(floor(20e0 * power(1.0563e0, i)) AS DOUBLE) AS f FROM (SELECT unnest(range(127)) AS i)")
def g6_graphic_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in grids.graphic_frequencies()], "f double")


@query(with_views("first_of", "points") + f""", ends AS (SELECT curve_id, min(f) AS lo, max(f) AS hi FROM points GROUP BY curve_id), k AS (SELECT unnest(range(0, 481)) AS k)
SELECT curve_id, {s6('f')} AS f FROM (SELECT curve_id, 20e0 * power(2e0, k / 48e0) AS f FROM ends, k WHERE 20e0 * power(2e0, k / 48e0) > lo AND 20e0 * power(2e0, k / 48e0) < hi UNION SELECT curve_id, lo FROM ends UNION SELECT curve_id, hi FROM ends)""")
def g7_display_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.display_grid(bridge.curve_points(spark, sf_dir)).select("curve_id", r6("f").alias("f"))


@query(with_views(*CURVE_VIEWS) + f"SELECT curve_id, idx, {s6('db')} AS db FROM placed")
def j1_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every curve on the evaluation grid."""
    return curves.interpolate_grid(bridge.curve_points(spark, sf_dir), _grid(spark), POINTS_PER_OCTAVE).select("curve_id", "idx", r6("db").alias("db"))


@query(with_views(*CURVE_VIEWS) + f"SELECT curve_id, {s6('offset_db')} AS offset_db FROM offsets")
def f7_normalization_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.normalization_offset_hz(bridge.curve_points(spark, sf_dir), ANCHOR_HZ).select("curve_id", r6("offset").alias("offset_db"))


@query(with_views(*CURVE_VIEWS) + f"SELECT curve_id, idx, {s6('db')} AS db FROM prepared")
def p1_prepare_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("curve_id", "idx", r6("db").alias("db"))


@query(with_views(*CURVE_VIEWS) + f"SELECT pair_id, idx, {s6('db')} AS db FROM wanted")
def p3_desired_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wanted(spark, sf_dir).select("pair_id", "idx", r6("db").alias("db"))


@query(with_views(*CURVE_VIEWS) + f"SELECT pair_id, {ERRORS} FROM wanted GROUP BY pair_id")
def a1_error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_errors(errors(spark, sf_dir))


def _bands_sql(bands: list[tuple[str, float, float]]) -> str:
    rows = ", ".join(f"('{n}', {a}e0, {b}e0)" for n, a, b in bands)
    return with_views(*CURVE_VIEWS) + f", bands(band, lo, hi) AS (VALUES {rows}) SELECT pair_id, band, {ERRORS} FROM wanted JOIN bands ON f BETWEEN lo AND hi GROUP BY pair_id, band"


@query(_bands_sql(METRIC_BANDS))
def j4_band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every response against its target, normalized at 500 Hz, by band."""
    return _rounded_errors(pairs.band_metrics(bridge.curve_pairs(spark, sf_dir), GRID, ANCHOR_HZ, METRIC_BANDS))


@query(_bands_sql(RESEARCH_BANDS))
def a19_research_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_errors(pairs.band_metrics(bridge.curve_pairs(spark, sf_dir), GRID, ANCHOR_HZ, RESEARCH_BANDS))


@query(with_views(*CURVE_VIEWS) + f", bands(zoom, lo, hi) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {a}e0, {b}e0)' for n, a, b in ZOOM_RANGES)}) SELECT curve_id, zoom, count(*) AS n, {s6('min(db)')} AS lo_db, {s6('max(db)')} AS hi_db FROM prepared JOIN bands ON f BETWEEN lo AND hi GROUP BY curve_id, zoom")
def p22_zoom_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.array(*[F.when(F.col("f").between(a, b), F.lit(n)) for n, a, b in ZOOM_RANGES])
    rows = prepared(spark, sf_dir).withColumn("zoom", F.explode(F.filter(inside, lambda z: z.isNotNull())))
    return rows.groupBy("curve_id", "zoom").agg(F.count(F.lit(1)).alias("n"), r6(F.min("db")).alias("lo_db"), r6(F.max("db")).alias("hi_db"))


@query(with_views(*CURVE_VIEWS) + f"SELECT pair_id, idx, {s6('db')} AS db FROM wanted WHERE f BETWEEN 100e0 AND 5000e0")
def p7_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wanted(spark, sf_dir).where(F.col("f").between(100.0, 5000.0)).select("pair_id", "idx", r6("db").alias("db"))


@query(with_views("first_of", "points") + """, m AS (SELECT curve_id, f > 0 AND isfinite(f) AND isfinite(db) AND coalesce(lag(f) OVER (PARTITION BY curve_id ORDER BY idx) < f, TRUE) AS ok FROM points)
SELECT curve_id, bool_and(ok) AND count(*) >= 2 AS ok FROM m GROUP BY curve_id""")
def p10_valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.valid_points(bridge.curve_points(spark, sf_dir))


@query(with_views("first_of", "points") + "SELECT curve_id, min(f) AS lo, max(f) AS hi, min(f) <= 20 AND max(f) >= 20000 AS covers FROM points GROUP BY curve_id")
def p19_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.coverage(bridge.curve_points(spark, sf_dir))


@query(with_views("first_of", "points") + f"SELECT curve_id, idx, f, {s6('db + CASE WHEN curve_id % 3 = 0 THEN label ELSE 0 END')} AS db FROM points")
def p20_display_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves with an id divisible by 3 have an offset (their label), the others none."""
    points = bridge.curve_points(spark, sf_dir)
    offsets = points.where("curve_id % 3 = 0").select("curve_id", F.col("label").cast("double").alias("offset")).distinct()
    return curves.display_offsets(points, offsets).select("curve_id", "idx", "f", r6("db").alias("db"))


@query(with_views("first_of", "points") + f", d AS (SELECT curve_id, idx, round(f / 50e0) * 50e0 + 50e0 AS f, db FROM points) SELECT curve_id, f, {s6('arg_max(db, idx)')} AS db FROM d GROUP BY curve_id, f")
def p23_last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies are first rounded to 50 Hz, so that low ones repeat."""
    points = bridge.curve_points(spark, sf_dir).withColumn("f", F.round(F.col("f") / 50e0) * 50e0 + 50e0)
    return curves.last_duplicate_wins(points).select("curve_id", "f", r6("db").alias("db"))


@query(with_views("first_of", "points") + ", d AS (SELECT curve_id, round(f / 50e0) * 50e0 + 50e0 AS f, db FROM points) SELECT curve_id, f, min(db) AS db, min(db) <> max(db) AS conflict FROM d GROUP BY curve_id, f")
def s9_collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = bridge.curve_points(spark, sf_dir).withColumn("f", F.round(F.col("f") / 50e0) * 50e0 + 50e0)
    return curves.collapse_duplicates(points)


@query(with_views("first_of", "points") + f""", b AS (SELECT f AS l, db AS ldb, lead(f) OVER (ORDER BY f) AS r, lead(db) OVER (ORDER BY f) AS rdb FROM points WHERE curve_id = (SELECT min(vec_id) FROM embeddings) AND f BETWEEN 50 AND 15000)
SELECT curve_id, idx, {s6('db - CASE WHEN f = l THEN ldb WHEN f = r THEN rdb ELSE ldb + ln(f / l) / ln(r / l) * (rdb - ldb) END')} AS db
FROM points JOIN b ON r IS NOT NULL AND f >= l AND (f < r OR (f = r AND r = (SELECT max(r) FROM b)))""")
def j8_display_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All curves less the first one's part between 50 Hz and 15 kHz; points outside it go."""
    points = bridge.curve_points(spark, sf_dir)
    first = bridge.table(spark, sf_dir, "embeddings").agg(F.min("vec_id").alias("curve_id"))
    base = points.join(F.broadcast(first), "curve_id").where("f BETWEEN 50 AND 15000").select("f", "db")  # one id
    return curves.against_baseline(points, base).select("curve_id", "idx", r6("db").alias("db"))


@query(with_views("first_of", "points", "segments") + f""", w AS (SELECT DISTINCT curve_id, f FROM points, (VALUES (10e0), (33e0), (777e0), (4321e0), (19999e0), (30000e0)) AS v(f0), LATERAL (SELECT f0 AS f))
SELECT w.curve_id, w.f, {s6('ldb + ln(w.f / l) / ln(r / l) * (rdb - ldb)')} AS db FROM w LEFT JOIN segments AS s ON s.curve_id = w.curve_id AND w.f >= l AND w.f < r""".replace("points, (VALUES (10e0), (33e0), (777e0), (4321e0), (19999e0), (30000e0)) AS v(f0), LATERAL (SELECT f0 AS f)", "(SELECT DISTINCT curve_id FROM points), (VALUES (10e0), (33e0), (777e0), (4321e0), (19999e0), (30000e0)) AS v(f)"))
def j10_graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six frequencies of every curve; null outside its coverage."""
    points = bridge.curve_points(spark, sf_dir)
    asked = F.array(*[F.lit(x) for x in (10.0, 33.0, 777.0, 4321.0, 19999.0, 30000.0)])
    ids = points.select("curve_id").distinct().withColumn("f", F.explode(asked))
    return curves.interpolate_asof(points, ids).select("curve_id", "f", r6("db").alias("db"))


@query(with_views("first_of", PAIRS) + "SELECT fr_id, target_id, f.label FROM pairs JOIN embeddings AS f ON f.vec_id = fr_id JOIN embeddings AS t ON t.vec_id = target_id AND t.label = f.label")
def j12_active_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each response with its target, both looked up by id."""
    ids = bridge.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = bridge.pairs(spark, sf_dir).join(ids.withColumnRenamed("vec_id", "fr_id"), "fr_id")
    return found.join(ids.withColumnRenamed("vec_id", "target_id"), ["target_id", "label"]).select("fr_id", "target_id", "label")


# --- features of the wanted correction ---------------------------------------------------------

@query(with_views(*CURVE_VIEWS) + f""", s AS (SELECT *, CASE WHEN abs(db) >= 0.5 THEN CASE WHEN db < 0 THEN -1 ELSE 1 END ELSE 0 END AS sign FROM wanted),
e AS (SELECT *, CAST(sign <> coalesce(lag(sign) OVER (PARTITION BY pair_id ORDER BY idx), 0) AS INTEGER) AS edge FROM s),
g AS (SELECT *, sum(edge) OVER (PARTITION BY pair_id ORDER BY idx) AS run FROM e WHERE TRUE)
SELECT pair_id, sign, min(idx) AS start_idx, max(idx) AS end_idx, {s6('min(f)')} AS start_hz, {s6('max(f)')} AS end_hz, {s6('log2(max(f) / min(f))')} AS octaves FROM g WHERE sign <> 0 GROUP BY pair_id, run, sign""")
def w1_residual_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.residual_regions(wanted(spark, sf_dir), "pair_id")
    return out.withColumns({c: r6(c) for c in ("start_hz", "end_hz", "octaves")})


@query(with_views(*CURVE_VIEWS) + f""", n AS (SELECT *, lag(db) OVER w AS p, lead(db) OVER w AS q FROM wanted WINDOW w AS (PARTITION BY pair_id ORDER BY idx))
SELECT pair_id, idx, {s6('db')} AS db FROM n WHERE p IS NOT NULL AND q IS NOT NULL AND abs(db) >= 0.15 AND ((db > 0 AND db >= p AND db > q) OR (db < 0 AND db <= p AND db < q))""")
def w2_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extrema(wanted(spark, sf_dir), "pair_id").select("pair_id", "idx", r6("db").alias("db"))


@query(with_views(*CURVE_VIEWS) + f""", n AS (SELECT *, lag(db) OVER w AS p, lead(db) OVER w AS q FROM wanted WINDOW w AS (PARTITION BY pair_id ORDER BY idx)),
x AS (SELECT pair_id, idx, db FROM n WHERE p IS NOT NULL AND q IS NOT NULL AND abs(db) >= 0.15 AND ((db > 0 AND db >= p AND db > q) OR (db < 0 AND db <= p AND db < q))),
c AS (SELECT x.pair_id, x.idx, x.db, (SELECT max(o.idx) FROM wanted AS o WHERE o.pair_id = x.pair_id AND o.idx < x.idx AND sign(o.db) <> sign(x.db)) AS lc, (SELECT min(o.idx) FROM wanted AS o WHERE o.pair_id = x.pair_id AND o.idx > x.idx AND sign(o.db) <> sign(x.db)) AS rc FROM x),
h AS (SELECT c.*, (SELECT max(o.idx) FROM wanted AS o WHERE o.pair_id = c.pair_id AND o.idx < c.idx AND o.idx > coalesce(c.lc, -1) AND abs(o.db) <= abs(c.db) / 2) AS hl, (SELECT min(o.idx) FROM wanted AS o WHERE o.pair_id = c.pair_id AND o.idx > c.idx AND o.idx < coalesce(c.rc, 958) AND abs(o.db) <= abs(c.db) / 2) AS hr FROM c)
SELECT pair_id, idx, coalesce(lc, hl, 0) AS left_idx, coalesce(rc, hr, 957) AS right_idx, coalesce(hl, lc, 0) AS half_left_idx, coalesce(hr, rc, 957) AS half_right_idx FROM h""")
def w3_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.boundaries(bridge.curve_pairs(spark, sf_dir), GRID, ANCHOR_HZ)


@query(with_views(*CURVE_VIEWS) + f""", n AS (SELECT *, coalesce(lag(abs(db)) OVER w, 0) AS p, coalesce(lead(abs(db)) OVER w, 0) AS q FROM wanted WINDOW w AS (PARTITION BY pair_id ORDER BY idx))
SELECT pair_id, {s6('arg_max(f, (abs(db), -idx))')} AS f, {s6('arg_max(db, (abs(db), -idx))')} AS db FROM n WHERE abs(db) >= p AND abs(db) >= q GROUP BY pair_id""")
def w5_strongest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.strongest_feature(wanted(spark, sf_dir), "pair_id").select("pair_id", r6("f").alias("f"), r6("db").alias("db"))


@query(with_views(*CURVE_VIEWS) + f""", t(type, lo, hi) AS (VALUES ('LS', 20e0, 200e0), ('HS', 8000e0, 20000e0)),
a AS (SELECT pair_id, type, count(*) FILTER (db > 0) AS up, count(*) FILTER (db < 0) AS down, count(*) AS n, median(db) AS gain, median(abs(db)) AS size, log2(max(f) / min(f)) AS octaves FROM wanted JOIN t ON f BETWEEN lo AND hi GROUP BY pair_id, type)
SELECT pair_id, type, {s6('least(15e0, greatest(-15e0, gain))')} AS gain, {s6('octaves')} AS octaves FROM a WHERE greatest(up, down) / n >= 0.7 AND size >= 0.5""")
def w10_shelf_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.shelf_evidence(wanted(spark, sf_dir), "pair_id").select("pair_id", "type", r6("gain").alias("gain"), r6("octaves").alias("octaves"))


#: Peaks of the wanted corrections, in the order in which they are taken.
_TOPS = """n AS (SELECT *, coalesce(lag(abs(db)) OVER w, 0) AS p, coalesce(lead(abs(db)) OVER w, 0) AS q FROM wanted WINDOW w AS (PARTITION BY pair_id ORDER BY idx)),
tops AS MATERIALIZED (SELECT pair_id, f, db, row_number() OVER (PARTITION BY pair_id ORDER BY abs(db) DESC, idx) AS k FROM n WHERE abs(db) >= 0.15 AND abs(db) >= p AND abs(db) >= q)"""


@query("WITH RECURSIVE " + with_views(*CURVE_VIEWS).removeprefix("WITH ") + f""", {_TOPS},
taken AS (
    SELECT pair_id, k, f, db, TRUE AS kept, [f] AS fs FROM tops WHERE k = 1
    UNION ALL
    SELECT t.pair_id, t.k, t.f, t.db, len(fs) < 8 AND len(list_filter(fs, lambda g: abs(log2(t.f / g)) < 0.5)) = 0, CASE WHEN len(fs) < 8 AND len(list_filter(fs, lambda g: abs(log2(t.f / g)) < 0.5)) = 0 THEN list_append(fs, t.f) ELSE fs END
    FROM taken JOIN tops AS t ON t.pair_id = taken.pair_id AND t.k = taken.k + 1)
SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY k) AS INTEGER) AS place, {s6('f')} AS f, {s6('db')} AS db FROM taken WHERE kept""")
def w4_separated_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight peaks of each correction, half an octave apart."""
    return features.separated_peaks(wanted(spark, sf_dir), "pair_id", 8, 0.5).select("pair_id", "place", r6("f").alias("f"), r6("db").alias("db"))


_RUNS = """s AS (SELECT *, CASE WHEN abs(db) >= 0.5 THEN CASE WHEN db < 0 THEN -1 ELSE 1 END ELSE 0 END AS sign FROM wanted),
e AS (SELECT *, CAST(sign <> coalesce(lag(sign) OVER (PARTITION BY pair_id ORDER BY idx), 0) AS INTEGER) AS edge FROM s),
g AS (SELECT *, sum(edge) OVER (PARTITION BY pair_id ORDER BY idx) AS run FROM e),
runs AS (SELECT pair_id, run, min(f) AS a, max(f) AS b, sqrt(min(f) * max(f)) AS c FROM g WHERE sign <> 0 GROUP BY pair_id, run),
sides AS (SELECT pair_id, run, a, b, c, max(w.f) FILTER (w.f <= c) AS lf, arg_max(w.db, w.f) FILTER (w.f <= c) AS ldb, min(w.f) FILTER (w.f >= c) AS rf, arg_min(w.db, w.f) FILTER (w.f >= c) AS rdb FROM runs JOIN wanted AS w USING (pair_id) WHERE w.f BETWEEN c / 1.02e0 AND c * 1.02e0 GROUP BY pair_id, run, a, b, c),
ends(type, nominal, lo, hi) AS (VALUES ('LS', 105e0, 20e0, 200e0), ('HS', 10000e0, 8000e0, 20000e0)),
shelves AS (SELECT pair_id, type, any_value(nominal) AS f, median(db) AS gain, log2(max(f) / min(f)) AS octaves FROM wanted JOIN ends ON f BETWEEN lo AND hi GROUP BY pair_id, type HAVING greatest(count(*) FILTER (db > 0), count(*) FILTER (db < 0)) / count(*) >= 0.7 AND median(abs(db)) >= 0.5),
every AS (
    SELECT pair_id, 'PK' AS type, c AS f, CASE WHEN lf = rf THEN ldb ELSE ldb + ln(c / lf) / ln(rf / lf) * (rdb - ldb) END AS gain, least(12e0, greatest(0.1e0, c / greatest(1e-9, b - a))) AS q, log2(b / a) AS octaves FROM sides
    UNION ALL SELECT pair_id, type, f, gain, 0.7e0, octaves FROM shelves),
ranked AS MATERIALIZED (SELECT pair_id, type, f, least(15e0, greatest(-15e0, gain)) AS gain, q, octaves, row_number() OVER (PARTITION BY pair_id ORDER BY round(octaves, 9) DESC, round(abs(least(15e0, greatest(-15e0, gain))), 9) DESC, f, CASE type WHEN 'LS' THEN 0 WHEN 'PK' THEN 1 ELSE 2 END) AS k FROM every)"""


def _candidates_sql(tolerance: str) -> str:
    near = f"len(list_filter(own, lambda o: o.type = t.type AND abs(log2(o.f / t.f)) <= {tolerance})) = 0"
    return "WITH RECURSIVE " + with_views(*CURVE_VIEWS).removeprefix("WITH ") + f""", {_RUNS},
taken AS (
    SELECT pair_id, k, TRUE AS kept, [{{'type': type, 'f': f}}] AS own FROM ranked WHERE k = 1
    UNION ALL
    SELECT t.pair_id, t.k, {near}, CASE WHEN {near} THEN list_append(own, {{'type': t.type, 'f': t.f}}) ELSE own END FROM taken JOIN ranked AS t ON t.pair_id = taken.pair_id AND t.k = taken.k + 1)
SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY k) AS INTEGER) AS place, type, {s6('f')} AS f, {s6('gain')} AS gain, {s6('q')} AS q, {s6('octaves')} AS octaves FROM taken JOIN ranked USING (pair_id, k) WHERE kept"""


def _candidates(spark: SparkSession, sf_dir: str, tolerance: float) -> DataFrame:
    out = pairs.candidates(bridge.curve_pairs(spark, sf_dir), GRID, ANCHOR_HZ, tolerance=tolerance)
    return out.select("pair_id", "place", "type", *[r6(c).alias(c) for c in ("f", "gain", "q", "octaves")])


@query(_candidates_sql("1 / 48e0"))
def o1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-generation candidates of every correction, with the product's tolerance."""
    return _candidates(spark, sf_dir, 1 / 48)


@query(_candidates_sql("0.5e0"))
def d3_tolerance_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with half an octave, within which many fall."""
    return _candidates(spark, sf_dir, 0.5)


@query(with_views(*CURVE_VIEWS) + f"SELECT pair_id, {s6('median(db)')} AS median_db, {s6('median(abs(db))')} AS median_abs_db FROM wanted GROUP BY pair_id")
def a6_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wanted(spark, sf_dir).groupBy("pair_id").agg(r6(F.median("db")).alias("median_db"), r6(F.median(F.abs("db"))).alias("median_abs_db"))


# --- kernels: no SQL ---------------------------------------------------------------------------

def _loudness_sql(level: float) -> str:
    """Offsets by Newton's method as a recursion over all curves; the parameters of each place by interpolation in the standard's table."""
    rows = ", ".join(f"({i}, {f}e0, {a}e0, {t}e0, {q}e0)" for i, (f, a, t, q) in enumerate(zip(loudness.ISO_F, loudness.ISO_ALPHA, loudness.ISO_TRANSFER, loudness.ISO_THRESHOLD, strict=True)))
    between = lambda c: f"lo.{c} + coalesce(ln(g.f / lo.f) / nullif(ln(hi.f / lo.f), 0), 0) * (hi.{c} - lo.{c})"
    return (
        "WITH RECURSIVE "
        + with_views("first_of", "points", "segments").removeprefix("WITH ")
        + f""", {GRID480}, {AT_480},
    iso(i, f, a, t, q) AS (VALUES {rows}),
    places AS (SELECT g.idx, {between('a')} AS a, {between('t')} AS t, {between('q')} AS q FROM grid AS g JOIN iso AS lo ON lo.i = (SELECT max(i) FROM iso WHERE iso.f <= g.f) JOIN iso AS hi ON hi.i = least(28, lo.i + 1)),
    terms AS (SELECT idx, a, 0.005076e0 / power(10e0, a * (log10(4) - 10 + t / 10)) - power(10e0, a * q / 10) AS o, power(10e0, 9.4e0 + 4 * a * (log10(4) - 10 + t / 10)) / 480 AS c FROM places),
    curve AS (SELECT curve_id, a, o, c, db FROM placed JOIN terms USING (idx)),
    newton AS (
        SELECT curve_id, 0 AS n, 0e0 AS x, 1e0 AS step FROM (SELECT DISTINCT curve_id FROM curve)
        UNION ALL
        SELECT curve_id, any_value(n) + 1, any_value(x) - (ln(sum(c * pow(o + p, 4))) - {level} * ln(10) / 10) * sum(c * pow(o + p, 4)) / sum(c * 4 * pow(o + p, 3) * a * p * ln(10) / 10),
               (ln(sum(c * pow(o + p, 4))) - {level} * ln(10) / 10) * sum(c * pow(o + p, 4)) / sum(c * 4 * pow(o + p, 3) * a * p * ln(10) / 10)
        FROM (SELECT curve_id, n, x, a, o, c, power(power(10e0, (db + x) / 10), a) AS p FROM newton JOIN curve USING (curve_id) WHERE abs(step) > 0.01) GROUP BY curve_id)
"""
    )


_LEVEL = _loudness_sql(60.0) + ", level AS (SELECT curve_id, arg_max(x, n) - 60 AS offset_db FROM newton GROUP BY curve_id) "


@query(_LEVEL + f"SELECT curve_id, {s6('offset_db')} AS offset_db FROM level")
def f8_loudness_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level mode at 60 dB in a flat free field: a measured table is data that callers give."""
    got = fits.normalization_offsets(bridge.curve_points(spark, sf_dir), Normalization("db", ANCHOR_HZ, 60.0), flat_field(spark))
    return got.select("curve_id", r6("offset").alias("offset_db"))


@query(_LEVEL.replace(GRID480, f"{GRID480}, {GRID958_AS}").replace(f", {AT_480}", f", {AT_480}, {AT_958}") + f"SELECT curve_id, idx, round(db + offset_db, 5) + 0.0e0 AS db FROM placed958 JOIN level USING (curve_id)")
def f7_level_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves on the evaluation grid, normalized to a loudness of 60 dB in a flat free field."""
    ready = fits.prepare_normalized(bridge.curve_points(spark, sf_dir), _grid(spark), POINTS_PER_OCTAVE, Normalization("db", ANCHOR_HZ, 60.0), flat_field(spark))
    return ready.select("curve_id", "idx", (F.round("db", 5) + F.lit(0.0)).alias("db"))


def _spline_sql(source: str) -> str:
    """The smoothing spline at level 5 of the curves of ``source`` (curve_id, f, db): elimination and substitution as recursions."""
    return f"""
k AS (SELECT curve_id, f, db AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY curve_id) AS n, ln(lead(f) OVER w) - ln(f) AS h FROM {source} WINDOW w AS (PARTITION BY curve_id ORDER BY f)),
v AS (SELECT *, power(0.05e0 * power(1e0 / 80, power(i / n, 2)), 2) AS s FROM k),
g AS (SELECT curve_id, i, n, h, lead(h) OVER w AS h1, 1 / h AS a, -1 / h - 1 / lead(h) OVER w AS b, 1 / lead(h) OVER w AS c, s, lead(s) OVER w AS s1, lead(s, 2) OVER w AS s2, y, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY curve_id ORDER BY i)),
m AS (SELECT curve_id, i, n, (h + h1) / 3 + a * a * s + b * b * s1 + c * c * s2 AS p, h1 / 6 + b * lead(a) OVER w * s1 + c * lead(b) OVER w * s2 AS q, c * lead(a, 2) OVER w * s2 AS r, a * y + b * y1 + c * y2 AS z FROM g WHERE i < n - 2 WINDOW w AS (PARTITION BY curve_id ORDER BY i)),
down AS (
    SELECT curve_id, i, n, p AS d, coalesce(q, 0) / p AS l, coalesce(r, 0) / p AS ll, z AS x, 0e0 AS d_1, 0e0 AS l_1, 0e0 AS ll_1, 0e0 AS x_1 FROM m WHERE i = 0
    UNION ALL
    SELECT m.curve_id, m.i, m.n, p - d * l * l - d_1 * ll_1 * ll_1, (coalesce(q, 0) - d * l * ll) / (p - d * l * l - d_1 * ll_1 * ll_1), coalesce(r, 0) / (p - d * l * l - d_1 * ll_1 * ll_1), z - l * x - ll_1 * x_1, d, l, ll, x FROM down JOIN m ON m.curve_id = down.curve_id AND m.i = down.i + 1),
up AS (
    SELECT curve_id, i, x / d AS u, 0e0 AS u_1 FROM down WHERE i = n - 3
    UNION ALL
    SELECT down.curve_id, down.i, down.x / down.d - down.l * u - down.ll * u_1, u FROM up JOIN down ON down.curve_id = up.curve_id AND down.i = up.i - 1),
e AS (SELECT v.curve_id, v.f, v.y, v.s, coalesce(g0.a * u0.u, 0) + coalesce(g1.b * u1.u, 0) + coalesce(g2.c * u2.u, 0) AS bend FROM v
    LEFT JOIN g AS g0 ON g0.curve_id = v.curve_id AND g0.i = v.i LEFT JOIN up AS u0 ON u0.curve_id = v.curve_id AND u0.i = v.i
    LEFT JOIN g AS g1 ON g1.curve_id = v.curve_id AND g1.i = v.i - 1 LEFT JOIN up AS u1 ON u1.curve_id = v.curve_id AND u1.i = v.i - 1
    LEFT JOIN g AS g2 ON g2.curve_id = v.curve_id AND g2.i = v.i - 2 LEFT JOIN up AS u2 ON u2.curve_id = v.curve_id AND u2.i = v.i - 2)
SELECT curve_id, {s6('f')} AS f, {s6('y - s * bend')} AS db FROM e"""


@query("WITH RECURSIVE " + with_views("first_of", "points").removeprefix("WITH ") + "," + _spline_sql("points"))
def f21_smoothing_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.smoothed(bridge.curve_points(spark, sf_dir), 5.0).select("curve_id", r6("f").alias("f"), r6("db").alias("db"))


_SERIES = """shown AS (SELECT * FROM points WHERE curve_id % 10 = 0), spans AS (SELECT curve_id, min(f) AS lo, max(f) AS hi FROM shown GROUP BY curve_id),
places AS (SELECT curve_id, 20e0 * power(2e0, k / 48e0) AS f FROM spans, (SELECT unnest(range(0, 481)) AS k) WHERE 20e0 * power(2e0, k / 48e0) > lo AND 20e0 * power(2e0, k / 48e0) < hi UNION SELECT curve_id, lo FROM spans UNION SELECT curve_id, hi FROM spans),
series AS MATERIALIZED (SELECT p.curve_id, p.f, CASE WHEN p.f = l THEN ldb WHEN p.f = r THEN rdb ELSE ldb + ln(p.f / l) / ln(r / l) * (rdb - ldb) END AS db FROM places AS p JOIN segments AS s ON s.curve_id = p.curve_id AND p.f >= l AND (p.f < r OR (is_last AND p.f = r)))"""


@query("WITH RECURSIVE " + with_views("first_of", "points", "segments", _SERIES).removeprefix("WITH ").rstrip() + "," + _spline_sql("series"))
def p21_prepared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth curve as a graph draws it: on the display grid, smoothed."""
    return smoothing.series(bridge.curve_rows(spark, sf_dir, "curve_id % 10 = 0"), 5.0).select("curve_id", r6("f").alias("f"), r6("db").alias("db"))


def _fit(engine: str, name: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fits.fit_pairs(wanted(spark, sf_dir), engine, **options)

    run.__name__ = name
    return run


# all pairs, with the product's own limits
query()(_fit("v1", "i1_fit_v1"))
query()(_fit("v2", "i11_fit_v2"))
query()(_fit("structural", "i39_fit_structural"))
