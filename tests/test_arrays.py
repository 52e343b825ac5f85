"""Presets as arrays, folds over arrays and scans in blocks, against plain numpy and plain windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eqspark.functions.bands import iterate, solve_two_bands
from eqspark.operators import filters as ops
from eqspark.operators import fits, grids, loudness, presets, research, scans, smoothing
from eqspark.operators.fitting import kernel
from eqspark.schema import Normalization

from .brute import loudness_offset, smooth

FILTERS = "preset_id long, ordinal int, enabled boolean, type string, f double, gain double, q double"
GRID = grids.evaluation_grid()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for preset in range(30):
        for i in range(rng.choice((1, 2, 5, 12, 64))):
            out.append((preset, i, rng.random() < 0.8, rng.choice(("PK", "PK", "LS", "HS")), 20 * 1000 ** rng.random(), rng.choice((0.0, rng.uniform(-15, 15), rng.uniform(-15, 15))), rng.choice((0.3, 0.7, 1.0, rng.uniform(0.1, 12)))))
    return [*out, (99, 0, False, "PK", 20.0, 3.0, 1.0)]


@pytest.fixture(scope="module")
def packed(spark, rows):
    return presets.packed(spark.createDataFrame(rows, FILTERS).repartition(5))


def own(rows, preset, enabled=True):
    return [x[3:] for x in rows if x[0] == preset and (x[2] or not enabled)]


def test_cascades(rows, packed):
    exact = kernel.Grid(np.array(GRID))
    for r in presets.cascades(packed, GRID).collect():
        assert np.abs(np.array(r.db) - exact.cascade(own(rows, r.preset_id))).max() < 1e-6


def test_a_peak_on_its_place_has_its_gain(spark):
    """Also at the lowest place, where sums of cosines lose digits."""
    df = spark.createDataFrame([(0, 0, True, "PK", 20.0, 3.0, 2.29), (1, 0, True, "LS", 20.0, -6.0, 0.7), (2, 0, True, "HS", 20_000.0, 5.0, 0.7)], FILTERS)
    got = {r.preset_id: r.db for r in presets.cascades(presets.packed(df), GRID).collect()}
    assert got[0][0] == pytest.approx(3.0, abs=1e-13) and got[1][0] == pytest.approx(-3.0, abs=1e-12) and got[2][-1] == pytest.approx(2.5, abs=1e-12)


def test_filter_levels(rows, packed):
    exact = kernel.Grid(np.array(GRID))
    got = {(r.preset_id, r.ordinal): r for r in presets.filter_levels(packed, GRID).collect()}
    assert len(got) == len(rows)
    for x in rows:
        level = exact.exact(x[3:])
        assert got[x[0], x[1]].sum_db == pytest.approx(level.sum(), abs=1e-4) and got[x[0], x[1]].top_db == pytest.approx(np.abs(level).max(), abs=1e-6)


def test_cancellations_and_audit(spark, rows, packed):
    exact = kernel.Grid(np.array(GRID))
    got = {(r.preset_id, r.a, r.b): r.score for r in presets.cancellations(packed, GRID).collect()}
    want = {}
    for preset in {x[0] for x in rows}:
        on = [x for x in rows if x[0] == preset and x[2]]
        want |= {(preset, on[i][1], on[j][1]): s for i, j, s in kernel.cancellation([x[3:] for x in on], exact)}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    wish = spark.createDataFrame([(p, [float(p)] * len(GRID)) for p in range(0, 30, 2)], "preset_id long, wish array<double>")
    for r in presets.audited(packed.join(wish, "preset_id", "left"), GRID, wanted="wish").collect():
        level = exact.cascade(own(rows, r.preset_id))
        wished = r.preset_id if r.preset_id % 2 == 0 else 0
        miss = np.maximum(0, np.abs(wished - level) - 0.1)
        assert r.fit == pytest.approx(np.where(miss <= 1, miss * miss / 2, miss - 0.5).mean(), abs=1e-7)
        assert r.boost_db == pytest.approx(max(0.0, level.max()), abs=1e-6) and r.enabled == len(own(rows, r.preset_id))
        assert {(p.a, p.b) for p in r.pairs} == {k[1:] for k in want if k[0] == r.preset_id}


def test_graphic_eq_bins(spark, rows):
    raw, centres = grids.raw_frequencies(), grids.graphic_frequencies()
    weights = ops.bin_weights(raw, centres)
    got = {}
    for r in ops.graphic_eq(spark.createDataFrame(rows, FILTERS)).collect():
        got.setdefault(r.preset_id, {})[r.f] = r.gain
    for preset in (0, 7, 99):
        level = kernel.Grid(np.array(raw)).cascade(own(rows, preset))
        bins = np.array([sum(w * level[i] for i, w in parts) for parts in weights])
        assert list(got[preset]) == [float(c) for c in centres] and np.allclose(list(got[preset].values()), bins - bins.max(), atol=1e-6)


def test_no_filter_becomes_rows_of_a_grid(spark):
    from eqspark.plans import catalog

    for name in ("f2_magnitude_full", "j3_cascade_full", "j5_cancellation_full", "a17_severity_counts_full", "a2_objective_full"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Exchange") == 1 and plan.count("explode") == 0


def test_two_bands(spark):
    rng = np.random.default_rng(4)
    systems = []
    for n in (1, 2, 3, 10, 40):
        d1, d2 = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)
        d1[n - 1 :], d2[max(0, n - 2) :] = 0, 0
        m = np.diag(rng.uniform(5, 9, n)) + np.diag(d1[: n - 1], 1) + np.diag(d1[: n - 1], -1)
        if n > 2:
            m += np.diag(d2[: n - 2], 2) + np.diag(d2[: n - 2], -2)
        systems.append((m, d1, d2, rng.normal(size=n)))
    data = [(i, [tuple(map(float, x)) for x in zip(np.diag(m), d1, d2, b, strict=True)]) for i, (m, d1, d2, b) in enumerate(systems)]
    df = spark.createDataFrame(data, "i int, rows array<struct<d0:double,d1:double,d2:double,b:double>>")
    for r in df.select("i", solve_two_bands(F.col("rows")).alias("x")).collect():
        m, _, _, b = systems[r.i]
        assert np.allclose(r.x, np.linalg.solve(m, b), atol=1e-12)


def test_iterate(spark):
    root = iterate(F.lit(1.0), lambda x: (x + F.col("a") / x) / 2, lambda before, after: F.abs(after - before) < 1e-14, 100)
    never = iterate(F.lit(0.0), lambda x: x + 1, lambda before, after: F.lit(False), 7)
    for r in spark.createDataFrame([(2.0,), (9.0,)], "a double").select("a", root.alias("r"), never.alias("n")).collect():
        assert r.r.x == pytest.approx(r.a**0.5, abs=1e-13) and r.r.done and r.n.x == 7 and not r.n.done


def test_smoothing(spark):
    rng = np.random.default_rng(5)
    curves = {f"c{n}": (np.sort(rng.uniform(20, 20_000, n)), rng.normal(0, 5, n)) for n in (1, 2, 3, 4, 5, 60)}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (f, y) in curves.items() for a, b in zip(f, y, strict=True)], "curve_id string, f double, db double")
    for level in (0.0, 5.0):
        got = {}
        for r in smoothing.smoothed(df, level).orderBy("curve_id", "f").collect():
            got.setdefault(r.curve_id, []).append(r.db)
        for k, (f, y) in curves.items():
            assert got[k] == pytest.approx(list(smooth(f, y, level)), abs=1e-9)


def test_loudness(spark):
    f = np.array(grids.loudness_grid())
    rng = np.random.default_rng(6)
    field = rng.normal(0, 3, 480)
    curves = {i: 60 + np.cumsum(rng.normal(0, 0.3, 480)) for i in range(3)}
    df = spark.createDataFrame([(i, k, float(f[k]), float(x)) for i, y in curves.items() for k, x in enumerate(y)] + [(9, 0, 20.0, 60.0)], "curve_id long, idx int, f double, db double")
    got = {r.curve_id: r.offset for r in loudness.offsets(df, 65.0, loudness.field_table(spark, field.tolist())).collect()}
    assert got.keys() == curves.keys()  # a curve that does not cover the grid has none
    for i, y in curves.items():
        assert got[i] == pytest.approx(loudness_offset(f, y, 65.0, field) - 65.0, abs=1e-9)
    plan = fits.normalization_offsets(df.select("curve_id", "f", "db"), Normalization("db", 500.0, 60.0), loudness.flat_field(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_scan_in_blocks(spark):
    """Blocks of three rows, a key with most of the rows, ties in the value, and a key with one row."""
    rng = random.Random(8)
    rows = [("hot" if i % 4 else f"k{i % 40}", i, round(rng.random(), 1), i % 3) for i in range(200)] + [("one", 5, 0.5, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, seq long, a double, b long")
    value = F.struct("a", "b")
    plain = scans.least_before(df, ["key"], ["seq"], value, "least")
    split = scans.least_before(df, ["key"], ["seq"], value, "least", most=3)
    assert split.columns == plain.columns
    key = lambda r: (r.key, r.seq)
    assert sorted(split.collect(), key=key) == sorted(plain.collect(), key=key)
    sizes = [r["count"] for r in df.repartitionByRange(67, "key", "seq").groupBy("key", F.spark_partition_id()).count().collect()]
    assert max(sizes) < 20  # the hot key has 150 rows


def test_histories_in_blocks(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"c{i % 9}", i, 100 * i, round(rng.uniform(0.1, 2), 2), round(rng.uniform(0.1, 3), 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "cell string, seq long, elapsed_ms long, rmse double, max_abs double")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(research.best_history(df), research.best_history(df, most=3))
    assert same(research.improving_checkpoints(df, ["cell"]), research.improving_checkpoints(df, ["cell"], most=3))
    assert sorted(map(str, research.time_to_quality(df).collect())) == sorted(map(str, research.time_to_quality(df, most=3).collect()))


def test_neighbours_in_blocks(spark):
    """Blocks of three rows, a curve with most points, keys of one and two points, windows that reach over more than one block."""
    rng = random.Random(10)
    rows = [("long" if i % 5 else f"c{i % 25}", float(20 + i), rng.choice((1.0, 2.0, -1.0, None))) for i in range(150)] + [("one", 20.0, 1.0), ("two", 20.0, 1.0), ("two", 30.0, 2.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "curve_id string, f double, db double")
    value = F.struct("f", "db")
    for before, after in ((1, 0), (0, 2), (2, 3)):
        plain, split = (scans.neighbours(df, ["curve_id"], ["f"], value, before, after, m) for m in (None, 3))
        assert split.columns == plain.columns
        assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_curves_in_blocks(spark):
    from eqspark.operators import curves, features

    rng = np.random.default_rng(11)
    f = np.unique(np.round(np.sort(rng.uniform(15, 21_000, 3000)), 6))
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(f, rng.normal(0, 3, len(f)), strict=True))] + [(2, 0, 20.0, 1.0), (2, 1, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "curve_id long, idx int, f double, db double")
    grid = grids.grid_frame(spark, GRID)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(curves.interpolate_grid(df, grid, 96), curves.interpolate_grid(df, grid, 96, most=500))
    assert same(curves.valid_points(df), curves.valid_points(df, most=500))
    assert same(features.extrema(df, "curve_id"), features.extrema(df, "curve_id", most=500))


def test_separated_peaks_and_candidates(spark):
    """Against the fitting kernels: peaks half an octave apart, and candidates without near-repeats."""
    from eqspark.operators import features
    from eqspark.operators.fitting import structural, v1
    from eqspark.schema import Settings

    rng = np.random.default_rng(12)
    f = np.array(GRID)
    curves = {k: np.convolve(rng.normal(0, 6, len(f) + 40), np.ones(k) / k, "same")[20:-20] for k in (2, 5, 20, 60)}
    df = spark.createDataFrame([(k, i, float(f[i]), float(x)) for k, y in curves.items() for i, x in enumerate(y)], "key long, idx int, f double, db double")
    got = {}
    for r in features.separated_peaks(df, "key", 8, 0.5).orderBy("key", "place").collect():
        got.setdefault(r.key, []).append((r.f, r.db))
    assert got == {k: structural.residual_features(f, y, 8, 0.5) for k, y in curves.items()}
    found = {}
    for r in features.candidates(df, "key").orderBy("key", "place").collect():
        found.setdefault(r.key, []).append((r.type, r.f, r.gain, r.q))
    for k, y in [x for x in curves.items() if x[0] >= 20]:  # of hundreds of narrow regions that lie close the order decides
        want = sorted(v1.Problem(f, y, Settings()).candidates(y))  # the kernel lets the last bits of equal widths decide their order
        found[k].sort()
        assert len(found[k]) == len(want) and all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9) for a, b in zip(found[k], want, strict=True))


def test_names_in_reading_order(spark):
    from eqspark.operators import ranking

    names = ["b", "A", "a", "é", "e", "Z", "_x", "10", "9", "-", "B"]
    df = spark.createDataFrame([("g", n, "") for n in names], "grp string, mutation string, key string")
    assert [r.mutation for r in ranking.ordered(df, "grp").orderBy("place").collect()] == ["_x", "-", "10", "9", "a", "A", "b", "B", "e", "é", "Z"]
