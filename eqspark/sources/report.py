"""Research reports: tables as JSON and a markdown summary of the aggregates, which are a few rows for each cell of a plan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..operators.research import RUN_KEYS


def _table(df: DataFrame, columns: list[tuple[str, str]]) -> str:
    """A markdown table of all cells of a plan, in key order. A plan's cells are written by hand (cases by budgets by capacities), so they are few."""
    show = lambda v: "null" if v is None else f"{v:.4f}" if isinstance(v, float) else ", ".join(f"{k}: {n}" for k, n in v.items()) if isinstance(v, dict) else str(v)
    rows = df.orderBy(*RUN_KEYS).select(*[c for c, _ in columns]).toLocalIterator()
    head = ["| " + " | ".join(t for _, t in columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


CELL = [("case_id", "Case"), ("budget_s", "Budget s"), ("max_filters", "Max filters")]


def summary(aggregates: DataFrame, deltas: DataFrame | None, warnings: DataFrame, compatible: bool = True, title: str = "Research bench") -> str:
    """The markdown summary. ``deltas``: compare's rows, or None if no comparison was asked for."""
    if deltas is None:
        compared = "Baseline comparison was not requested."
    elif not compatible:
        compared = "Baseline comparison: **baseline-incompatible**. No deltas were calculated."
    elif deltas.isEmpty():
        compared = "Baseline comparison is compatible, but no matching cells were found."
    else:
        compared = _table(deltas, CELL + [(c, c) for c in deltas.columns if c.endswith("_delta")])
    warned = warnings.orderBy("case_id", "max_filters", "shorter_s").toLocalIterator()
    lines = [f"- **Warning:** {w.case_id}, {w.max_filters} filters: {w.longer_s} s is worse than {w.shorter_s} s; rmse by {w.rmse_delta:.4f} dB, largest deviation by {w.max_abs_delta:.4f} dB" for w in warned]
    parts = [
        f"# {title}",
        "## Baseline deltas",
        compared,
        "## Quality and runtime",
        _table(aggregates, [*CELL, ("run_count", "Runs"), ("rmse_median", "RMSE median"), ("max_abs_median", "Largest deviation median"), ("achieved_rate", "Target rate"), ("elapsed_median", "Elapsed median ms")]),
        "## Time to quality",
        _table(aggregates, [*CELL, ("joint_median_ms", "Joint target median ms"), ("joint_worst_ms", "Joint target worst ms")]),
        "## Stability",
        _table(aggregates, [*CELL, ("rmse_spread", "RMSE spread"), ("max_abs_spread", "Largest deviation spread"), *([("reasons", "Terminations")] if "reasons" in aggregates.columns else [])]),
        "## Monotonicity warnings",
        "\n".join(lines) or "No practical monotonicity warnings.",
    ]
    return "\n\n".join(parts) + "\n"


def write(path: str, aggregates: DataFrame, deltas: DataFrame | None, warnings: DataFrame, runs: DataFrame | None = None, timeline: DataFrame | None = None, metadata: dict | None = None, **options) -> None:
    """The artefacts of a plan under ``path`` (any file system that Spark writes to): ``summary`` as text, and as JSON the results, warnings, deltas, runs, timeline,
    profile (counters of the runs with deep telemetry; empty if none has it) and metadata, as far as they are given."""
    spark = aggregates.sparkSession
    text = lambda value, name: spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    text(summary(aggregates, deltas, warnings, **options), "summary")
    profile = None if runs is None else runs.where("mode = 'deep'").select(*RUN_KEYS, "repeat", "counters")
    for name, df in (("results", aggregates), ("warnings", warnings), ("deltas", deltas), ("runs", runs), ("timeline", timeline), ("profile", profile)):
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")
    if metadata is not None:
        text(json.dumps(metadata, sort_keys=True), "metadata")
