"""Golden vectors of operators and kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eqspark.functions import text
from eqspark.operators import curves, features, filters, fits, grids, metrics, ranking, research
from eqspark.operators.fits import preamp_of
from eqspark.operators.fitting import structural, v1, v2
from eqspark.operators.fitting.kernel import Grid, biquad_db, cancellation, half_up_step, nearest_step
from eqspark.operators.fitting.loudness import FREE_FIELD_PLACES, flat_free_field, free_field_of
from eqspark.schema import EqError, Normalization, Settings
from eqspark.sources import curve_text, filter_text
from eqspark.streaming import recorder

from .brute import loudness_offset, smooth
from .cases import FIRST, SOLVABLE, wished_level

def points(spark, rows):
    return spark.createDataFrame([(1, i, float(f), float(d)) for i, (f, d) in enumerate(rows)], "curve_id long, idx int, f double, db double")


def test_grids():
    assert grids.log_grid(100, 400, 1) == [100, 200, 400]
    assert grids.log_grid(100, 300, 1) == [100, 200, 300]
    assert [len(x) for x in (grids.evaluation_grid(), grids.loudness_grid(), grids.raw_frequencies(), grids.graphic_frequencies())] == [958, 480, 963, 127]
    with pytest.raises(EqError):
        grids.log_grid(100, 100, 1)


def test_interpolation_and_normalization(spark):
    p = points(spark, [(100, 0), (10000, 20)])
    asked = spark.createDataFrame([(1, 100.0), (1, 1000.0), (1, 10000.0), (1, 99.0), (1, 10001.0)], "curve_id long, f double")
    got = {r.f: r.db for r in curves.interpolate_asof(p, asked).collect()}
    assert got[100] == 0 and got[10000] == 20 and got[1000] == pytest.approx(10) and got[99] is None and got[10001] is None
    assert curves.interpolate_asof(p, asked, how="inner").count() == 3
    offset = curves.normalization_offset_hz(points(spark, [(100, 80), (10000, 100)]), 1000.0).first().offset
    assert offset == pytest.approx(-90)


def test_metrics_first_on_ties(spark):
    r = spark.createDataFrame([(1, 0, 100.0, -2.0), (1, 1, 1000.0, 2.0), (1, 2, 10000.0, 1.0)], "k int, idx int, f double, db double")
    assert metrics.error_metrics(r, ["k"]).first().max_abs_hz == 100
    r = spark.createDataFrame([(1, i, f, d) for i, (f, d) in enumerate([(100.0, 1.0), (1000.0, -2.0), (10000.0, 3.0)])], "k int, idx int, f double, db double")
    m = metrics.error_metrics(r, ["k"]).first()
    assert (m.mae, m.max_abs, m.max_abs_hz) == (2, 3, 10000) and m.rmse == pytest.approx(math.sqrt(14 / 3))


def test_regions(spark):
    r = spark.createDataFrame([(1, i, f, d) for i, (f, d) in enumerate([(100.0, 1.0), (200.0, 1.0), (400.0, -1.0), (800.0, -1.0)])], "k int, idx int, f double, db double")
    assert sorted((x.start_idx, x.end_idx, x.sign) for x in features.residual_regions(r, "k").collect()) == [(0, 1, 1), (2, 3, -1)]
    assert v1.regions(np.array([1, 0.49, 1]), 0.5) == [(0, 0), (2, 2)]


def test_biquads():
    f = np.array([20.0, 1000.0, 19_000.0])
    assert np.abs(biquad_db("PK", 1000, 0, 1, f)).max() < 1e-12
    assert biquad_db("PK", 1000, 6, 1, f)[1] == pytest.approx(6, abs=1e-9)
    assert biquad_db("LS", 300, 6, 0.7, f)[0] == pytest.approx(6, abs=0.05) and abs(biquad_db("LS", 300, 6, 0.7, f)[2]) < 0.01
    g = np.array(grids.evaluation_grid())
    for x in (("PK", 1000.0, 4.0, 2.0), ("LS", 120.0, -6.0, 0.7), ("HS", 9000.0, 5.0, 0.7)):
        assert np.abs(Grid(g).response(x) - Grid(g, expanded=True).response(x)).max() < 1e-6


def test_full_grid_queries(spark, monkeypatch):
    """The queries on the evaluation grid against brute force; on the coarse grid these narrow filters fall between places."""
    from eqspark.plans import catalog, filter_queries

    sets = {1: [("PK", 1060.0, 15.0, 12.0), ("PK", 1075.0, -15.0, 12.0), ("LS", 120.0, 4.0, 0.7)], 2: [("PK", 3000.0, 9.0, 11.0), ("PK", 3100.0, -9.0, 3.0)]}
    rows = [(k, i, True, *x) for k, s in sets.items() for i, x in enumerate(s)]
    table = spark.createDataFrame(rows, "preset_id long, ordinal int, enabled boolean, type string, f double, gain double, q double")
    monkeypatch.setattr(filter_queries.bridge, "filters", lambda *_: table)
    g = Grid(np.array(grids.evaluation_grid()))
    run = lambda name: catalog.queries()[name](spark, "").collect()
    want = {(k, a, b): s for k, x in sets.items() for a, b, s in cancellation(x, g)}
    got = {(r.preset_id, r.a, r.b): r.score for r in run("j5_cancellation_full")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    for r in run("a17_severity_counts_full"):
        own = [s for k, s in want.items() if k[0] == r.preset_id]
        assert (r.strong, r.moderate) == (sum(s >= 0.65 for s in own), sum(s < 0.65 for s in own)) and r.total_score == pytest.approx(sum(own), abs=1e-6)
    level = {k: g.cascade(x) for k, x in sets.items()}
    cascade = run("j3_cascade_full")
    assert len(cascade) == 2 and all(len(r.db) == 958 and r.db == pytest.approx(list(level[r.preset_id]), abs=1e-4) for r in cascade)
    # sums are rounded to four places, so that engines that add in another order agree
    for name, tolerance in (("f2_magnitude_full", 1e-4), ("f5_magnitude_expanded", 1e-2)):
        for r in run(name):
            db = g.response(sets[r.preset_id][r.ordinal])
            assert r.top_db == pytest.approx(np.abs(db).max(), abs=tolerance) and r.sum_db == pytest.approx(db.sum(), abs=tolerance)
    for r in run("a2_objective_full"):
        m = np.maximum(0, np.abs(level[r.preset_id]) - 0.1)
        own = sum(0.01 + 0.002 * max(0, math.log2(q / 2)) ** 2 + 0.0005 * max(0, abs(gain) - 6) ** 2 for _, _, gain, q in sets[r.preset_id])
        total = sum(s for k, s in want.items() if k[0] == r.preset_id)
        assert r.objective == pytest.approx(np.where(m <= 1, 0.5 * m * m, m - 0.5).mean() + own + 0.01 * total, abs=1e-5)


def test_preamp(spark):
    rows = [(1, 0, True, "PK", 1000.0, 3.0, 1.0), (1, 1, True, "PK", 1000.0, 3.0, 1.0), (2, 0, False, "PK", 1000.0, 3.0, 1.0), (3, 0, True, "PK", 1000.0, 3.01, 1.0)]
    df = spark.createDataFrame(rows, "preset_id long, ordinal int, enabled boolean, type string, f double, gain double, q double")
    got = {r.preset_id: r for r in filters.preamp(df).collect()}
    assert got[1].max_boost_db == pytest.approx(6, abs=1e-3) and got[1].preamp_db <= -6
    assert got[2].preamp_db == 0 and got[2].max_boost_hz == 20 and got[3].preamp_db == pytest.approx(-3.1)


def test_graphic_bins():
    w = filters.bin_weights([20.0, 1000.0, 19000.0], [20.0, 100.0, 1000.0])
    db = [sum((0, 10, 20)[i] * x for i, x in ws) for ws in w]
    assert db[1] == pytest.approx(math.log(5) / math.log(50) * 10)


def test_cancellation():
    g = Grid(np.array(grids.evaluation_grid()))
    score = lambda a, b: [s for _, _, s in cancellation([("PK", a, 15, 1), ("PK", b, -15, 1)], g)]
    assert score(1000, 1000)[0] == pytest.approx(1, abs=0.01) and 0.35 <= score(1000, 1400)[0] < 0.65 and not score(1000, 2100)


def test_steps():
    assert [nearest_step(1000.5, 1, 20, 20000), nearest_step(0.05, 0.1, -15, 15, True), nearest_step(1.005, 0.01, 0.1, 12)] == [1000, 0, 1]
    assert [nearest_step(1000.6, 1, 20, 20000), nearest_step(2.26, 0.1, -15, 15, True), nearest_step(1.236, 0.01, 0.1, 12)] == [1001, 2.3, 1.24]
    assert half_up_step(-0.5, 1, -5, 5) == 0


@pytest.mark.parametrize("case", FIRST, ids=lambda c: c[0])
def test_first_fit_gives_the_published_filters(case):
    _, wished, cap, rmse, max_abs, want, preamp = case
    f, level = wished_level(wished, 500.0)
    got = v1.fit(f, level, Settings(max_filters=cap))
    assert [tuple(x) for x in got.filters] == [(t, float(f), float(g), float(q)) for t, f, g, q in want]
    assert got.rmse == pytest.approx(rmse, abs=5.1e-5) and got.max_abs == pytest.approx(max_abs, abs=5.1e-5) and preamp_of(got.filters) == preamp


@pytest.mark.parametrize("case", SOLVABLE, ids=lambda c: c[0])
def test_second_fit_solves_the_solvable_cases(case):
    _, wished, cap = case
    f, level = wished_level(wished, 500.0)
    got, used, why = v2.fit(f, level, Settings(max_filters=cap), 200_000)
    assert got.rmse <= 0.25 and got.max_abs <= 0.75 and len(got.filters) <= cap and used < 200_000 and why == "target-reached"
    deep, _, _ = structural.fit(f, level, Settings(max_filters=cap), 60_000)
    assert deep.rmse <= 0.25 and deep.max_abs <= 0.75 and len(deep.filters) <= cap


def test_refinement_goes_on_where_it_stopped():
    f, level = wished_level([("PK", 1000, 6, 2), ("PK", 3000, -4, 3)])
    p = v2.Problem(f, level, Settings(), v2.Budget(10**6))
    start = p.solution([("PK", 900.0, 4.0, 1.5), ("PK", 3300.0, -3.0, 2.0)])
    whole = v2.Refinement(p, start)
    by_cycle = v2.Refinement(p, start)
    by_cycle.advance()
    assert by_cycle.completed == 1 and not by_cycle.done and by_cycle.solution.better(start)
    assert whole.run().filters == by_cycle.run().filters and whole.trials == by_cycle.trials and len(whole.trace) == whole.completed
    assert [c.index for c in whole.trace] == [1, 2, 3, 4, 5, 6][: whole.completed] and all(c.gain >= 0 and c.completed for c in whole.trace)
    short = v2.Refinement(p, start, max_trials=5)
    short.run()
    assert short.expired and short.trials == 5 and short.completed == 0 and not short.trace[0].completed
    assert p.joint(start).filters == whole.solution.filters


def test_input_rules():
    from eqspark.operators.fitting.kernel import check_input, same_grid

    for f, db in (([100.0], [1.0]), ([100.0, 200.0], [1.0]), ([200.0, 100.0], [1.0, 2.0]), ([0.0, 100.0], [1.0, 2.0]), ([100.0, 200.0], [1.0, math.nan])):
        with pytest.raises(EqError):
            check_input(np.array(f), np.array(db))
    same_grid(Grid(np.array([1.0, 2.0])), Grid(np.array([1.0, 2.0])))
    with pytest.raises(EqError):
        same_grid(Grid(np.array([1.0, 2.0])), Grid(np.array([1.0, 3.0])))


def test_structural_results_are_sound(spark):
    """What the gate lets through is a valid result with its marker; other settings are refused."""
    from eqspark.operators import acceptance, runner
    from eqspark.sources import session

    f, level = wished_level([("PK", 1000, 6, 2)], 500.0)
    wanted = spark.createDataFrame([(7, i, float(a), float(b)) for i, (a, b) in enumerate(zip(f, level))], "pair_id long, idx int, f double, db double")
    got = runner.structural_results(wanted, max_evaluations=4000)
    row = got.select("filters", F.col("manifest.experimental").alias("e"), acceptance.valid_result(F.struct("filters", "metrics", "preampDb", "manifest"), session.valid_manifest(F.col("manifest"))).alias("ok")).first()
    assert row.ok and row.filters and row.e.preset == structural.EXPERIMENTAL
    with pytest.raises(EqError):
        runner.structural_results(wanted, settings=Settings(max_filters=9))


def test_deadline():
    """A clock that ticks a second a look: the fit ends in time, with the best that it has, and equally each time."""
    f, level = wished_level([("PK", 1800, 3.5, 1.4), ("PK", 2400, -4, 4.5), ("PK", 3200, 3.8, 5.5), ("PK", 4100, -3.6, 6)], 500.0)

    def run(seconds):
        ticks = iter(range(10**7))
        return v2.traced_fit(f, level, budget=v2.Budget(10**6, seconds=seconds, clock=lambda: next(ticks)))

    short, long = run(500), run(5000)
    assert short[1] <= 500 and short[2] == "evaluation-limit" and run(500)[0] == short[0]
    violation = lambda fit: max(fit.rmse / 0.25, fit.max_abs / 0.75)
    assert violation(long[0]) <= violation(short[0])


def test_telemetry_of_a_fit():
    f, level = wished_level([("PK", 1000, 6, 2)])
    got, used, why, told = v2.traced_fit(f, level)
    assert told.checkpoints[-1][2] == got.rmse and [c[0] for c in told.checkpoints] == sorted(c[0] for c in told.checkpoints)
    assert told.counts["candidates_generated"] >= told.counts["candidates_shortlisted"] > 0 and told.counts["peak_working_filters"] >= 1 and set(told.counts) <= set(v2.COUNTERS)


def _search(wished, cap=10, evaluations=10**6, preset=structural.EXPERIMENTAL):
    f, level = wished_level(wished)
    out = structural.Search(v2.Problem(f, level, Settings(max_filters=cap), v2.Budget(evaluations)), structural.resolve_search(preset))
    out.best = out.judged((), out.next_id())
    return out


def test_structural_names_and_order():
    item = structural.Item("a", "PK", 1000.0, 3.0, 1.5)
    assert structural.filter_key([item]) == '[{"id":"a","enabled":true,"type":"PK","frequencyHz":1000,"gainDb":3,"q":1.5}]'
    assert structural.filter_key([item], False) == structural.filter_key([item._replace(id="b")], False) and structural.proposal_key("split", [item]).startswith('{"mutation":"split","filters":[{"enabled":true')
    assert structural.unique_id([item, item._replace(id="a-1")], "a") == "a-2" and structural.split_depth("x-split-low-split-high") == 2
    assert sorted(["b-1", "a", "B", "a_1", "10", "2", "a-1"], key=structural.collated) == ["10", "2", "a", "a_1", "a-1", "b-1", "B"] or sorted(["a_1", "a-1"], key=structural.collated) == ["a_1", "a-1"]
    assert [x.type for x in structural.canonical([item, item._replace(type="HS"), item._replace(type="LS")])] == ["LS", "PK", "HS"]
    assert structural.quota([1, 2, 3, 4], [4, 3, 2, 1], lambda x: x, 2, 1, 4) == [1, 2, 4, 3] and structural.quota([1, 1, 2], [2], lambda x: x, 6, 2, 8) == [1, 2]
    assert structural.resolve_search() == structural.Preset() and structural.resolve_search(structural.EXPERIMENTAL, 5) == structural.Preset(4, 8, quota=True, short=True)


def test_structural_mutations():
    s = _search([("PK", 1000, 6, 2)])
    state = s.judged((structural.Item("a", "PK", 1000.0, 3.0, 2.0), structural.Item("b", "PK", 1040.0, 1.0, 1.0), structural.Item("c-split-x-split-y", "PK", 5000.0, 1.0, 1.0), structural.Item("d", "LS", 100.0, 1.0, 0.7)))
    found = [(name, items) for name, items in s.mutations(state)]
    count = lambda n: sum(name == n for name, _ in found)
    assert (count("remove"), count("merge"), count("type-mutation"), count("add-pk")) == (4, 1, 1, 1) and count("split") == 3  # one filter has split twice
    one = next(items for name, items in found if name == "merge")
    new = next(x for x in one if x.id == "merge-a-b")
    assert new.gain == 4 and new.q == 1.5 and new.f == pytest.approx(2 ** ((3 * math.log2(1000) + math.log2(1040)) / 4))
    assert all(any(x.id.endswith("-split-low") for x in items) for name, items in found if name == "split")
    legacy = structural.regional_mutations(s, state, 2, 0.5)
    assert {n for n, _ in legacy} >= {"add-pk", "add-ls", "add-hs"} and sum(n == "split" for n, _ in legacy) == 4
    assert {n for n, _ in structural.regional_mutations(s, state, 2, 0.5, semantic=True)} <= {"add-pk", "add-ls", "add-hs", "remove", "type-mutation", "split", "merge"}
    features = structural.residual_features(np.array([100.0, 200, 400, 800, 1600]), np.array([1.0, -3, 0.1, 2, 0]), 3, 1.5)
    assert features == [(200.0, -3.0), (800.0, 2.0)]


def test_structural_beam_keeps_the_front():
    state = lambda i, rmse, top: structural.State(i, (), rmse, top, 0.0)
    states = [state("0", 1.0, 1.0), state("1", 0.5, 2.0), state("2", 0.6, 2.5), state("3", 0.4, 3.0), state("4", 1.0, 1.0)]
    assert [x.id for x in structural.pareto_beam(states, 9)] == ["0", "1", "3", "4"]
    assert [x.id for x in structural.pareto_beam(states, 2)] == ["0", "1"] or len(structural.pareto_beam(states, 2)) == 2


def test_structural_repairs_only_improve():
    wished = [("PK", 90, 2, 1.2), ("PK", 220, -2.4, 1.5), ("PK", 520, 2.8, 1.8), ("PK", 1200, -3, 2), ("PK", 2600, 3.2, 2.4)]
    s = _search(wished, cap=3)
    start = s.judged(s.on_steps([structural.Item("a", "PK", 100.0, 1.0, 1.0), structural.Item("b", "PK", 1200.0, -1.0, 1.0), structural.Item("c", "LS", 200.0, 1.0, 0.7)]))
    swapped = s.improved(start, s.replacements(start, "swap"), structural.TRIALS)
    assert swapped is not None and structural.dominates(swapped, start) and len(swapped.items) <= 3
    for seeds in (s.edges(start), s.interiors(start)):
        better = s.improved(start, seeds, structural.REPAIR_TRIALS)
        assert better is None or structural.dominates(better, start)
    assert s.improved(start, iter(()), 8) is None
    end = s.repaired(start)
    assert end.violation <= start.violation and len(end.items) <= 3
    solved = s.judged(s.on_steps([structural.Item(str(i), t, float(f), float(g), float(q)) for i, (t, f, g, q) in enumerate(wished)]))
    assert solved.achieved and s.simplified(solved).violation <= solved.violation
    assert len(s.cleaned(solved, 0.1, 0.5, 3).items) <= 5 and s.cleaned(solved, 0.1, 0.0, 3) is solved and len(s.pruned(solved, 100.0).items) == 4
    assert structural.within_tolerance(solved, solved, 0.0)


def test_registered_fits_use_the_product_limits(spark, monkeypatch):
    from eqspark.operators import fits
    from eqspark.plans import catalog, curve_queries

    seen = {}

    def caught(wanted, engine="v1", settings=Settings(), max_evaluations=20_000, key="pair_id"):
        seen[engine] = (settings, max_evaluations)

    monkeypatch.setattr(fits, "fit_pairs", caught)
    monkeypatch.setattr(curve_queries, "wanted", lambda *_: None)
    for name in ("i1_fit_v1", "i11_fit_v2", "i39_fit_structural"):
        catalog.queries()[name](spark, "")
    assert seen == dict.fromkeys(("v1", "v2", "structural"), (Settings(), 20_000)) and Settings().max_filters == 10


def test_second_and_structural_fits_keep_bounds():
    f = np.array(grids.evaluation_grid())
    wished = Grid(f).cascade([("PK", 1000, 6, 2), ("LS", 120, 4, 0.7)])
    for engine in (v2, structural):
        got, used, why = engine.fit(f, wished, Settings(max_filters=5), 15_000)
        again = engine.fit(f, wished, Settings(max_filters=5), 15_000)
        assert got.filters == again[0].filters and used <= 15_000 and len(got.filters) <= 5
        assert got.rmse < np.sqrt((wished**2).mean()) and why in ("target-reached", "converged", "evaluation-limit")
        assert all(20 <= x[1] <= 20000 and -15 <= x[2] <= 15 and 0.1 <= x[3] <= 12 for x in got.filters)


def test_spline():
    want = [0.0991931852, 2.7817225693, -1.8466625615, 3.9679777951, 0.0022189363, 0.9998875365]
    assert smooth(np.array([100, 200, 500, 1000, 5000, 10000]), np.array([0, 3, -2, 4, 0, 1]), 5) == pytest.approx(want, abs=1e-9)
    assert list(smooth([1, 2], [3, 4], 5)) == [3, 4]


def test_loudness_solves_its_own_equation():
    f, field = np.array(grids.loudness_grid()), flat_free_field()
    a, b = loudness_offset(f, np.full(480, 60.0), 60, field), loudness_offset(f, np.full(480, 70.0), 60, field)
    assert a - b == pytest.approx(10, abs=0.02)
    shifted = loudness_offset(f, np.full(480, 60.0), 60, free_field_of([7.0 + 3.0] * FREE_FIELD_PLACES))
    assert shifted - a == pytest.approx(3, abs=0.02)
    with pytest.raises(EqError):
        loudness_offset(f[:1], [60.0], 60, field)
    with pytest.raises(EqError):
        free_field_of([0.0] * 3)


def test_level_mode(spark, tmp_path):
    from eqspark.operators.fitting.loudness import read_free_field

    rows = [(k, i, f, d + lift) for k, lift in ((1, 0.0), (2, 10.0)) for i, (f, d) in enumerate(((20.0, 60.0), (1000.0, 62.0), (20000.0, 58.0)))] + [(3, 0, 100.0, 1.0), (3, 1, 20000.0, 2.0)]
    p = spark.createDataFrame(rows, "curve_id long, idx int, f double, db double")
    (tmp_path / "field.txt").write_text("\n".join(["7"] * FREE_FIELD_PLACES))
    field = read_free_field(spark, str(tmp_path / "field.txt"))
    grid = grids.grid_frame(spark, grids.evaluation_grid())
    got = fits.prepare_normalized(p, grid, 96, Normalization("db", 500.0, 60.0), field)
    level = {(r.curve_id, r.idx): r.db for r in got.collect()}
    assert {k for k, _ in level} == {1, 2} and len(level) == 2 * 958 and max(abs(level[1, i] - level[2, i]) for i in range(958)) < 0.05
    hz = fits.prepare_normalized(p, grid, 96, Normalization("hz", 1000.0, 60.0))
    assert {r.curve_id for r in hz.collect()} == {1, 2, 3}
    with pytest.raises(EqError):
        fits.normalization_offsets(p, Normalization("db", 500.0, 60.0))


def test_prepared_series(spark):
    p = points(spark, [(100, 0), (200, 3), (200, 4), (500, -2), (1000, 4), (5000, 0), (10000, 1)])
    shown = spark.createDataFrame([(1,)], "curve_id long")
    assert fits.prepared_series(p, shown.where("false"), 5.0).count() == 0
    plain = {r.f: r.db for r in fits.prepared_series(p, shown, 0.0).collect()}
    assert len(plain) == 6 and plain[200] == 4
    smooth_rows = fits.prepared_series(p, shown, 5.0).collect()
    assert len(smooth_rows) == 2 + sum(100 < 20 * 2 ** (k / 48) < 10_000 for k in range(481)) and min(r.f for r in smooth_rows) == 100 and max(r.f for r in smooth_rows) == 10000


def test_pareto_front_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SPREAD", 3)
    rng = np.random.default_rng(1)
    rows = [(int(g) if g else None, i, *map(float, rng.integers(0, 6, 3))) for i, g in enumerate(rng.integers(0, 4, 400))]
    df = spark.createDataFrame(rows, "grp int, id long, a double, b double, c double").repartition(7)
    got = sorted(r.id for r in ranking.pareto_front(df, "grp", ("a", "b", "c")).collect())
    beats = lambda x, y: all(p <= q for p, q in zip(x[2:], y[2:])) and x[2:] != y[2:]
    assert got == sorted(y[1] for y in rows if not any(x[0] == y[0] and beats(x, y) for x in rows))
    assert ranking.pareto_front(df.where("false"), "grp", ("a", "b", "c")).count() == 0


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_exact_medians(spark, most):
    """Groups far larger than what a task may hold, with ties, one value alone and values that are never reached."""
    rng = np.random.default_rng(2)
    groups = {"ties": rng.integers(0, 3, 101).astype(float), "even": rng.normal(0, 1e6, 200), "one": np.array([4.0]), "same": np.full(50, 2.5), "wide": np.append(10.0 ** rng.uniform(-300, 300, 60), [research.NEVER] * 41), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x], "k string, v double").repartition(5)
    got = {r.k: r for r in research.medians(df, ["k"], most).collect()}
    for k, x in groups.items():
        x = np.sort(x)
        p, q = x[(len(x) - 1) // 2], x[len(x) // 2]
        assert (got[k].n, got[k].least, got[k].most) == (len(x), x[0], x[-1]) and got[k].median == pytest.approx(p if p == q else p / 2 + q / 2, rel=1e-12)


def test_baseline_drops_what_it_does_not_cover(spark):
    base = spark.createDataFrame([(100.0, 1.0), (1000.0, 3.0), (1010.0, 5.0)], "f double, db double")
    p = points(spark, [(50, 9), (100, 9), (500, 9), (1000, 9), (1005, 9), (1010, 9), (2000, 9)])
    got = {r.f: r.db for r in curves.against_baseline(p, base).collect()}
    want = {f: 9 - np.interp(math.log(f), np.log([100, 1000, 1010]), [1, 3, 5]) for f in (100.0, 500.0, 1000.0, 1005.0, 1010.0)}
    assert got == pytest.approx(want)


def test_parse_curves(spark):
    texts = {"tab": "﻿# c\r\nHz\tdB\r\n100\t1\r\n20\t2\r\n100\t1", "bad": "1,2,3\n4,5,6", "two": "100,1\n100,2\n", "empty": "# x\n\n", "inf": "100 Infinity\n200 1", "neg": "-1;2\n2;3", "one": "20 1", "semi": "20;1\n; note\n//x\n30;2"}
    got = {r.path: r for r in curve_text.parse_curves(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert [(p.frequency_hz, p.db) for p in got["tab"].points] == [(20, 2), (100, 1)] and got["semi"].delimiter == "semicolon"
    assert {k: got[k].error_category for k in ("bad", "two", "empty", "inf", "neg", "one")} == {"bad": "parse", "two": "validation", "empty": "validation", "inf": "validation", "neg": "validation", "one": "validation"}


def test_parse_filters(spark):
    texts = {1: "Preamp: -3 dB\nFilter 1: ON PK Fc 1000 Hz Gain 3.0 dB Q 1.41\nFilter 2: OFF LSC Fc 105 Hz Gain -2 dB\n", 2: "Filter 1: ON PK Fc 1000 Hz Gain 3 dB", 3: "nothing", 4: "Filter 1: ON PK Fc 1000 Hz Gain 30 dB Q 1"}
    got = filter_text.parse_filters(spark.createDataFrame(list(texts.items()), "preset_id long, text string")).orderBy("preset_id", "ordinal").collect()
    assert [(r.preset_id, r.enabled, r.type, r.q) for r in got if r.error is None] == [(1, True, "PK", 1.41), (1, False, "LS", 0.707)]
    assert {r.preset_id: r.error.split(":")[0] for r in got if r.error} == {2: "parse", 3: "parse", 4: "validation"}


def test_fixed_decimals(spark):
    values = [0.15, 0.25, 1.005, 2.5, -0.04, 0.35, 1e-9, 12.345, 19.95]
    from decimal import ROUND_HALF_UP, Decimal

    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 3):
        got = [r[0] for r in df.select(text.fixed(F.col("x"), places)).collect()]
        want = [str(Decimal(v).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in values]
        assert got == [w[1:] if float(w) == 0 and w[0] == "-" else w for w in want]


def test_time_to_quality(spark):
    rows = [("a", 100, 1.2, 2.5), ("a", 200, 0.9, 2.0), ("a", 300, 0.95, 1.0), ("a", 400, 0.2, 0.7)]
    df = spark.createDataFrame(rows, "cell string, elapsed_ms long, rmse double, max_abs double")
    r = research.time_to_quality(df).first()
    assert (r.rmse100_ms, r.joint_ms, r.maxabs200_ms) == (200, 400, 200)
    runs = spark.createDataFrame([("c", 5, 10, x, 1.0, 1.0, False, "t", j) for x, j in ((0.4, 0.0), (0.2, None), (0.8, 400.0))], "case_id string, budget_s int, max_filters int, rmse double, max_abs double, elapsed_ms double, achieved boolean, termination string, joint_ms double")
    a = research.aggregate_runs(runs).first()
    assert (a.rmse_best, a.rmse_median, a.rmse_worst) == (0.2, 0.4, 0.8) and a.joint_median_ms == 400 and a.joint_worst_ms is None


def test_history():
    h = recorder.History()
    assert [h.record(t, s) for t, s in ((0, "a"), (100, "a"), (500, "b"), (2000, "c"))] == ["appended", "same", "replaced", "appended"]
    h.pin("a", h.snapshots[-1].number)
    assert h.record(2100, "d") == "appended"
    h.suppress_next()
    assert h.record(9000, "e") == "skipped" and recorder.History.load(h.dump()) == h
    log = recorder.EditLog(1)
    log.edit(2)
    log.edit(3)
    log.undo()
    assert log.present == 2
    log.redo()
    assert log.present == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", i * 700, i, f"s{i // 4}") for i in range(40)]
    schema = "key string, at_ms long, seq long, state string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = recorder.record_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("history").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.key, r.at_ms, r.state, r.outcome, r.kept)
    assert sorted(map(key, spark.table("history").collect())) == sorted(map(key, recorder.record_batch(df).collect()))


def test_settings():
    assert Settings().valid() and not Settings(min_hz=30, max_hz=30).valid() and not Settings(time_limit_s=7).valid() and Settings(time_limit_s=7).valid(timed=False) and not Settings(max_filters=65).valid()
