"""Findings of the third review, third session: each test fails on the code before."""

import numpy as np
import pyarrow as pa
import pytest

from eqspark.operators import grids, presets
from eqspark.operators.fitting import kernel

from .test_findings_r03 import FILTERS, sets


def _block(spark, rows):
    lists = presets.packed(spark.createDataFrame(rows, FILTERS)).orderBy("preset_id").select("filters").toArrow()["filters"].combine_chunks()
    return presets.Block(lists if isinstance(lists, pa.ListArray) else lists.chunk(0), np.sin(np.pi * np.array(grids.evaluation_grid()) / 48_000) ** 2)


def test_f17_f21_f24_f25_a_fold_takes_few_logarithms(spark, monkeypatch):
    """The extent of a response and the sums of filters take a logarithm for a run of places; a response takes one a place, whatever its filters."""
    rows = [*sets(40), (40, 0, False, "PK", 100.0, 3.0, 1.0), *[(41, i, True, "LS", 20_000.0, 400.0, 0.7) for i in range(12)], *[(42, i, True, "PK", 900.0 + i, 14.0, 9.0) for i in range(20)]]
    block, exact = _block(spark, rows), kernel.Grid(np.array(grids.evaluation_grid()))
    taken = []
    log2 = presets.np.log2
    monkeypatch.setattr(presets.np, "log2", lambda x, **k: taken.append(np.size(x)) or log2(x, **k))
    level = np.array([exact.cascade([x[3:] for x in rows if x[0] == p and x[2]]) for p in range(43)])
    lo, hi, mean = block.extent()
    for got, want in ((lo, level.min(axis=1)), (hi, level.max(axis=1)), (mean, level.mean(axis=1)), (block.cascade(), level)):
        assert got == pytest.approx(want, abs=1e-7, rel=1e-9)
    taken.clear()
    few = _block(spark, [x for x in rows if x[1] < presets.FACTORS])
    few.extent()
    assert 0 < sum(taken) < 0.1 * len(few.size) * len(few.s)
    taken.clear()
    fit, boost = block.losses()
    miss = np.maximum(0, np.abs(level) - 0.1)
    assert fit == pytest.approx(np.where(miss <= 1, miss * miss / 2, miss - 0.5).mean(axis=1), rel=1e-9) and boost == pytest.approx(np.maximum(0, level.max(axis=1)), abs=1e-7, rel=1e-9)
    taken.clear()
    total, top = block.sums()
    assert 0 < sum(taken) < (0.1 * len(block.f) + 12) * len(block.s)
    each = np.array([exact.exact(x[3:]) for x in sorted(rows)])
    assert total == pytest.approx(each.sum(axis=1), abs=1e-6) and top == pytest.approx(np.abs(each).max(axis=1), abs=1e-7)


def test_f18_a_text_is_judged_once(spark, tmp_path, monkeypatch):
    """What a batch holds twice, or another batch holds, is not judged."""
    from eqspark.sources import curve_text
    from jobs import import_texts as job

    settings, table, seen = job.config(), str(tmp_path / "texts"), []
    spark.createDataFrame([], job.schema(settings)).write.partitionBy("verdict", "batch").parquet(table)
    monkeypatch.setattr(job, "judged", lambda rows, s, judged=job.judged: seen.append(rows.count()) or judged(rows, s))
    rows = [("a", str(i % 4), "Hz dB\n20 1\n30 2" if i % 2 else "prose", "en", None) for i in range(12)]
    batch = spark.createDataFrame(rows, "origin string, id string, text string, lang string, source string")
    job.write_batch(batch, 0, table, settings)
    job.write_batch(batch.union(spark.createDataFrame([("a", None, "x", None, None)], batch.schema)), 1, table, settings)
    got = spark.read.schema(job.schema(settings)).parquet(table).collect()
    assert seen == [4, 1] and sorted((r.id or "", r.verdict, r.n_lines) for r in got) == [("", "rejected", 1), ("0", "rejected", 1), ("1", "curve", 3), ("2", "rejected", 1), ("3", "curve", 3)]
