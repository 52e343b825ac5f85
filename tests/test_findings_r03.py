"""Tests of what the third review found: whole jobs that grew faster than their input."""

import random

import numpy as np
import pyarrow as pa

from eqspark.operators import filters as ops
from eqspark.operators import grids, presets
from eqspark.operators.fitting import kernel

FILTERS = "preset_id long, ordinal int, enabled boolean, type string, f double, gain double, q double"


def sets(n, seed=5):
    rng = random.Random(seed)
    return [(p, i, rng.random() < 0.7, rng.choice(("PK", "LS", "HS")), 20 * 1000 ** rng.random(), rng.choice((0.0, rng.uniform(-15, 15))), rng.uniform(0.1, 12)) for p in range(n) for i in range(rng.choice((1, 3, 7, 64)))]


def test_f1_preamp_bounds_stretches(spark, monkeypatch):
    """The top is that of every place, but only few places are looked at."""
    rows, dense = sets(40), np.array(grids.dense_grid())
    exact = kernel.Grid(dense)
    got = {r.preset_id: r for r in ops.preamp(spark.createDataFrame(rows, FILTERS)).collect()}
    for p in range(40):
        level = exact.cascade([x[3:] for x in rows if x[0] == p and x[2]])
        top = max(0.0, float(level.max()))
        assert abs(got[p].max_boost_db - top) < 1e-6
        if top > 1e-6:
            assert level[np.argmin(np.abs(dense - got[p].max_boost_hz))] > top - 1e-6
    looked = []
    power = presets.Block.power
    monkeypatch.setattr(presets.Block, "power", lambda self, at, s=None: looked.append((len(at), (self.s if s is None else s).shape[-1])) or power(self, at, s))
    lists = presets.packed(spark.createDataFrame(rows, FILTERS)).select("filters").toArrow()["filters"].combine_chunks()
    block = presets.Block(lists if isinstance(lists, pa.ListArray) else lists.chunk(0), np.sin(np.pi * dense / 48_000) ** 2)
    block.peaks()
    assert sum(a * b for a, b in looked) < 0.2 * int(block.on.sum()) * len(dense)


def test_f9_expanded_form_makes_no_rows(spark):
    from eqspark.functions.dsp import with_coefficients

    rows = sets(6)
    frame = presets.expanded_levels(with_coefficients(spark.createDataFrame(rows, FILTERS)), grids.evaluation_grid())
    grid = kernel.Grid(np.array(grids.evaluation_grid()), expanded=True)
    got = {(r.preset_id, r.ordinal): r for r in frame.collect()}
    assert len(got) == len(rows)
    for x in rows:
        db = grid.response(x[3:])
        assert abs(got[x[:2]].sum_db - db.sum()) < 1e-2 and abs(got[x[:2]].top_db - np.abs(db).max()) < 1e-2
    plan = frame._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_f4_a_grid_goes_with_its_pair():
    """What a fit remembers is bounded in bytes, and goes without the collector of cycles."""
    import gc
    import weakref

    gc.disable()
    try:
        grid = kernel.Grid(np.array(grids.evaluation_grid()))
        rng = random.Random(2)
        a, b = ("PK", 1000.0, 3.0, 1.0), ("PK", 1100.0, -3.0, 1.0)
        assert kernel.opposing(a, b, grid) == kernel.opposing(a, b, grid) > 0
        for _ in range(6000):
            grid.response(("PK", rng.uniform(20, 20_000), 3.0, 1.0))
        assert sum(x.nbytes for x in grid.held.values()) <= kernel.HELD_BYTES
        gone = weakref.ref(grid)
        del grid
        assert gone() is None
    finally:
        gc.enable()


def test_f12_display_grid_shuffles_no_places(spark):
    points = spark.createDataFrame([(1, 20.0), (1, 500.0), (1, 20_000.0), (2, 30.0), (2, 30.0), (3, 20.0), (3, 20.1)], "curve_id long, f double")
    frame = grids.display_grid(points)
    got = {}
    for r in frame.collect():
        got.setdefault(r.curve_id, []).append(r.f)
    every = [20.0 * 2 ** (k / 48) for k in range(481)]
    for c, lo, hi in ((1, 20.0, 20_000.0), (2, 30.0, 30.0), (3, 20.0, 20.1)):
        want = sorted({lo, hi, *[x for x in every if lo < x < hi]})
        assert np.allclose(sorted(got[c]), want) and len(got[c]) == len(want)
    assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(curve_id") <= 2  # by curve alone (once, shown in both plans)


def test_f13_graphic_texts_are_made_in_rows(spark):
    from eqspark.sources import filter_text

    frame = spark.createDataFrame(sets(12, 8), FILTERS)
    want = {r.preset_id: r.text for r in filter_text.format_graphic(ops.graphic_eq(frame)).collect()}
    got = filter_text.format_graphic_items(ops.graphic_items(frame))
    assert {r.preset_id: r.text for r in got.collect()} == want and len(want) == 12
    assert presets._tenths(np.array([0.25, 0.35, 0.05, 0.15, 0.0, 2.675, 0.95])).tolist() == [3, 3, 1, 1, 0, 27, 9]
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_f26_manual_texts_alike(spark):
    from pyspark.sql import functions as F

    from eqspark.sources import filter_text

    filters = ops.quantize(spark.createDataFrame([*sets(12, 9), (98, 0, False, "PK", 20.0, 3.0, 1.0), *[(97, i, True, "PK", 50.0, 1.0, 1.0) for i in range(65)]], FILTERS))
    named = filters.select("preset_id").distinct().withColumns({"name": F.concat(F.lit("p "), F.col("preset_id")), "preamp_db": F.lit(-6.0)})
    want = {tuple(r) for r in filter_text.format_manual_entry(filters, named).collect()}
    got = filter_text.format_manual_alike(filters, F.concat(F.lit("p "), F.col("preset_id")), F.lit(-6.0))
    assert {tuple(r) for r in got.collect()} == want and len(want) == 14
    assert next(r for r in got.collect() if r.preset_id == 97).error == "export: more than 64 filters"
    assert "Join" not in got._jdf.queryExecution().toString()


def test_f2_a_key_reads_its_events_once():
    """However many events the watermark has passed, one timer folds them all."""
    from types import SimpleNamespace as Names

    from eqspark.streaming import histories

    class State:
        def __init__(self):
            self.value, self.reads = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.reads += 1
            return self.value

        def put(self, x):
            self.value = x

        update = put

        def appendList(self, x):  # noqa: N802
            self.value = [*(self.value or []), *x]

        def clear(self):
            self.value = None

    for debounce in (0, 5):
        make = lambda debounce=debounce: histories.Recording(debounce)
        timers, states = set(), []
        handle = Names(getListState=lambda *_: states.append(State()) or states[-1], getValueState=lambda *_: states.append(State()) or states[-1], registerTimer=timers.add)
        names = [x.split()[0] for x in histories.OUTCOME.split(", ")]
        p = histories.Ordered(make, names, debounce, histories.IDLE_MS)
        p.init(handle)
        events = [(1000 + 3 * i, i, None, f"s{i}") for i in range(300)]
        p.handleInputRows(("k",), [dict(zip(p.columns, e, strict=True)) for e in reversed(events)], Names(getCurrentWatermarkInMs=lambda: 0))
        assert len(timers) == 2
        got, watermark = [], 1601
        while due := sorted(t for t in timers if t < watermark):
            timers.remove(due[0])
            got += p.handleExpiredTimer(("k",), Names(getCurrentWatermarkInMs=lambda w=watermark: w), Names(getExpiryTimeInMs=lambda t=due[0]: t))
        fold = make()
        want = [r for e in events if e[0] < watermark for r in fold.step(e)] + fold.flush(watermark - 1)
        assert [(r.at_ms, r.state, r.outcome, r.kept) for r in got] == want and states[0].reads <= 2
