"""Session documents and research reports."""

import json

from eqspark.operators import research
from eqspark.plans import research_queries
from eqspark.sources import report, session

from .oracle import DATA

SETTINGS = {"minFrequencyHz": 20, "maxFrequencyHz": 20000, "minGainDb": -15, "maxGainDb": 15, "minQ": 0.1, "maxQ": 12, "maxFilters": 10}
CURVE = lambda i, kind: {"id": i, "name": i, "kind": kind, "rawPoints": [{"frequencyHz": 20, "db": 1}, {"frequencyHz": 20000, "db": 2}], "metadata": {}}
FILTER = {"id": "f1", "enabled": True, "type": "PK", "frequencyHz": 1000, "gainDb": 3, "q": 1}
GOOD = {"schemaVersion": 1, "curves": [CURVE("a", "fr"), CURVE("b", "target")], "activeFrId": "a", "activeTargetId": "b", "normalization": {"mode": "hz", "frequencyHz": 500, "levelDb": 60}, "autoeqSettings": SETTINGS, "filters": [FILTER], "filterProvenance": "manual", "solutionState": "clean", "autoEqRun": None}
RUN = {"manifest": {"schemaVersion": 3, "sampleRateHz": 48000, "autoeqSettings": {**SETTINGS, "timeLimitSeconds": 60}, "normalization": GOOD["normalization"], "finalFilters": [FILTER], "metrics": {"maeDb": 0.1, "rmseDb": 0.2, "maxAbsDb": 0.5, "maxAbsFrequencyHz": 100}, "preampDb": -3, "targetAchieved": True, "terminationReason": "target-reached"}}
FIT = {**GOOD, "filterProvenance": session.FITTED, "autoEqRun": RUN}


def test_sessions(spark):
    cases = {
        "good": (GOOD, None),
        "fit": (FIT, None),
        "meta": ({**GOOD, "curves": [{**CURVE("a", "fr"), "metadata": {"x": 1, "y": "t", "z": True, "w": 2.5}}, CURVE("b", "target")]}, None),
        "version": ({**GOOD, "schemaVersion": 9}, "unsupported version"),
        "settings": ({**GOOD, "schemaVersion": 2}, "invalid settings"),
        "twice": ({**GOOD, "curves": [CURVE("a", "fr"), CURVE("a", "fr")], "activeTargetId": None}, "duplicate curve ids"),
        "kind": ({**GOOD, "activeFrId": "b"}, "the active response is no response curve"),
        "bounds": ({**GOOD, "filters": [{**FILTER, "q": 99}]}, "malformed filter"),
        "orphan": ({**GOOD, "filterProvenance": None}, "filters without provenance"),
        "state": ({**GOOD, "solutionState": "stale"}, "an unfitted solution must be clean"),
        "norun": ({**FIT, "autoEqRun": None}, "fitted provenance needs a run"),
        "other": ({**FIT, "filters": [{**FILTER, "gainDb": 4}]}, "filters differ from the run"),
        "nested": ({**GOOD, "curves": [{**CURVE("a", "fr"), "metadata": {"x": {"y": 1}}}, CURVE("b", "target")]}, "malformed curve"),
        "bare": ({**GOOD, "curves": [{k: v for k, v in CURVE("a", "fr").items() if k != "metadata"}, CURVE("b", "target")]}, "malformed curve"),
        "claim": ({**FIT, "autoEqRun": {"manifest": {**RUN["manifest"], "targetAchieved": False}}}, "invalid run"),
    }
    rows = [(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("text", "no json")]
    read = session.read_sessions(spark.createDataFrame(rows, "path string, text string"))
    got = {r.path: r.error for r in read.collect()}
    assert {k: got[k] for k in cases} == {k: e for k, (_, e) in cases.items()} and got["text"] == "not a session document"
    text = session.write_sessions(read)
    again = session.read_sessions(text)
    assert [r.error for r in again.collect()] == [None] * 3 and session.session_points(again).count() == 12
    assert json.loads(text.where("path = 'good'").first().text)["autoeqSettings"]["timeLimitSeconds"] == 60


def test_report(spark, tmp_path):
    aggregates = research_queries._aggregates(spark, DATA)
    warnings = research.monotonicity_warnings(aggregates)
    text = report.summary(aggregates, None, warnings)
    assert text.startswith("# Research bench") and "not requested" in text and text.count("\n|") > 40
    report.write(str(tmp_path / "out"), aggregates, research.compare(aggregates, aggregates, ["rmse_median"]), warnings)
    assert spark.read.json(str(tmp_path / "out/results")).count() == aggregates.count()


def test_research_plan(spark, tmp_path):
    """Cases, cells and repeats to verified rows and artefacts."""
    import pytest
    from pyspark.sql import functions as F

    from eqspark.operators import acceptance, grids, metrics, runner
    from eqspark.plans import research_cli

    wished = spark.createDataFrame([(1, 0, True, "PK", 1000.0, 6.0, 2.0), (2, 0, True, "LS", 120.0, 5.0, 0.7), (2, 1, True, "PK", 3000.0, -4.0, 2.0)], "preset_id long, ordinal int, enabled boolean, type string, f double, gain double, q double")
    cases = runner.synthetic_cases(wished, grids.grid_frame(spark, grids.evaluation_grid()), 1)
    assert {(r.case_id, r.category) for r in cases.select("case_id", "category").distinct().collect()} == {(1, "solvable"), (2, "stress")}
    desired = cases.select("case_id", "idx", "f", F.col("desired").alias("db"))
    options = research_cli.parse(["--preset", "quick", "--repeats", "2", "--profile", "1:15"], ["1", "2"])
    cells = research.research_cells(spark, options.cases, [5, 15], options.max_filters, profile=options.profile)
    out = runner.execute(desired, cells, options.repeats, path=str(tmp_path / "plan"), metadata={"commit": "c"})
    runs = out["runs"].collect()
    assert len(runs) == 8 and all(r.rmse < 0.3 for r in runs) and sum(r.mode == "deep" for r in runs) == 2
    assert out["aggregates"].count() == 4 and runner.faults(out["runs"], desired.where("case_id = 1").select("case_id")).count() == 0
    text = spark.read.text(str(tmp_path / "plan/summary"), wholetext=True).first()[0]
    assert "Terminations" in text and spark.read.json(str(tmp_path / "plan/profile")).count() == 2 and spark.read.json(str(tmp_path / "plan/timeline")).count() > 0
    assert json.loads(spark.read.text(str(tmp_path / "plan/metadata")).first()[0]) == {"commit": "c"}
    assert research.compare(out["aggregates"], out["aggregates"], ["rmse_median"]).where("rmse_median_delta <> 0").count() == 0
    bad = out["runs"].withColumn("rmse", F.col("rmse") + 0.01).withColumn("filters", F.when(F.col("repeat") == 0, F.col("filters")).otherwise(F.array().cast(out["runs"].schema["filters"].dataType)))
    keys, names = runner.CASE_KEYS, ["mae", "rmse", "max_abs", "max_abs_hz"]
    assert acceptance.drifted(bad.select(*keys, *names), runner.recomputed(bad, desired), keys).count() == 8
    with pytest.raises(Exception, match="differ"):
        acceptance.strict_metrics(bad.select(*keys, *names), runner.recomputed(bad, desired), keys).collect()
    assert {r.fault for r in runner.faults(bad).collect()} == {"repeats differ"}
    none = runner.run_plan(desired, cells.where("budget_s = 5"), 1, "none").collect()
    assert all(not r.filters and r.termination == "converged" for r in none)
    assert metrics is not None and runner.read_baseline(spark, str(tmp_path / "nothing.json")) is None
    (tmp_path / "b.json").write_text('{"identity": {"schemaVersion": 1}}')
    assert runner.read_baseline(spark, str(tmp_path / "b.json")).first().identity.schemaVersion == 1


def test_cases_from_files(spark, tmp_path):
    from eqspark.operators import runner

    line = lambda lift: "\n".join(f"{f}\t{d + lift}" for f, d in ((20, 0), (500, 1), (20000, 2)))
    for name, lift in (("s", 0), ("a", 0), ("b", 5)):
        (tmp_path / f"{name}.txt").write_text(line(lift))
    cases = runner.load_cases(spark, str(tmp_path / "s.txt"), {"a": str(tmp_path / "a.txt"), "b": str(tmp_path / "b.txt")})
    assert cases.count() == 2 * 958 and cases.where("abs(db) > 1e-9").count() == 0  # both are the source but for a constant


def test_history_operations(spark):
    """Pins keep a snapshot from being replaced; suppressed and cleared states."""
    from eqspark.streaming import recorder

    rows = [(0, "record", "a"), (100, "pin-a", "a"), (200, "record", "b"), (300, "suppress", None), (400, "record", "c"), (500, "record", "d"), (600, "pin-b", "nothing"), (5000, "clear", None), (6000, "record", "a")]
    df = spark.createDataFrame([("k", at, i, state, op) for i, (at, op, state) in enumerate(rows)], "key string, at_ms long, seq long, state string, op string")
    got = [(r.outcome, r.kept) for r in recorder.record_batch(df).orderBy("at_ms").collect()]
    assert got == [("appended", 1), ("pinned", 1), ("appended", 2), ("suppress", 2), ("skipped", 2), ("replaced", 2), ("unpinned", 2), ("clear", 0), ("appended", 1)]
    edits = [("edit", "1"), ("edit", "2"), ("undo", None), ("undo", None), ("undo", None), ("redo", None), ("edit", "3"), ("redo", None), ("replace", "4"), ("undo", None)]
    log = spark.createDataFrame([("k", i, op, v) for i, (op, v) in enumerate(edits)], "key string, seq long, op string, value string")
    assert [r.present for r in recorder.edit_states(log).orderBy("seq").collect()] == ["1", "2", "1", None, None, "1", "3", "3", "4", "1"]
