"""Change history: debounce, coalescing snapshots, stale results, run states; in batch over ordered events and as streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EqError

DEBOUNCE_MS, COALESCE_MS, KEEP = 500, 1000, 100


def debounce(events: DataFrame, key: str, ts: str, value: str, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """key, first_ts, last_ts, n, value: the last event of each burst, whose events are at most ``gap_ms`` apart.

    Works on batch and streaming frames (a stream needs a watermark on ``ts``).
    """
    w = F.session_window(F.col(ts), f"{gap_ms} milliseconds")
    out = events.groupBy(F.col(key), w).agg(F.min(ts).alias("first_ts"), F.max(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "first_ts", F.col("x.t").alias("last_ts"), "n", F.col("x.v").alias("value"))


def changes(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Events whose values differ from the one before (null-safe); the first counts as a change."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*values)
    before = F.lag(now).over(w)
    return events.withColumn("_c", F.row_number().over(w).eqNullSafe(1) | ~now.eqNullSafe(before)).where("_c").drop("_c")


@dataclass
class Snapshot:
    at_ms: int
    state: str
    number: int


@dataclass
class History:
    """Snapshots of one key; A and B pin snapshots by number."""

    snapshots: list[Snapshot] = field(default_factory=list)
    a: int | None = None
    b: int | None = None
    next_number: int = 0
    skip: int = 0

    def record(self, at_ms: int, state: str, keep: int = KEEP, coalesce_ms: int = COALESCE_MS) -> str:
        """What became of a state: skipped, same, replaced or appended."""
        if self.skip:
            self.skip -= 1
            return "skipped"
        newest = self.snapshots[-1] if self.snapshots else None
        if newest is not None and newest.state == state:
            return "same"
        number, self.next_number = self.next_number, self.next_number + 1
        if newest is not None and at_ms - newest.at_ms < coalesce_ms and newest.number not in (self.a, self.b):
            self.snapshots[-1] = Snapshot(at_ms, state, number)
            return "replaced"
        self.snapshots.append(Snapshot(at_ms, state, number))
        del self.snapshots[:-keep]
        held = {s.number for s in self.snapshots}
        self.a, self.b = (x if x in held else None for x in (self.a, self.b))
        return "appended"

    def pin(self, side: str, number: int | None) -> None:
        if number is None or any(s.number == number for s in self.snapshots):
            setattr(self, side, number)

    def suppress_next(self) -> None:
        self.skip = 1

    def clear(self) -> None:
        self.snapshots, self.a, self.b = [], None, None

    def steer(self, op: str, state: str | None) -> str:
        """What is not a recording: pin-a, pin-b (the newest snapshot of ``state``, or none), suppress, clear."""
        if op in ("pin-a", "pin-b"):
            number = next((s.number for s in reversed(self.snapshots) if s.state == state), None)
            self.pin(op[-1], number)
            return "unpinned" if number is None else "pinned"
        if op == "suppress":
            self.suppress_next()
        elif op == "clear":
            self.clear()
        else:
            raise EqError("validation", f"unknown operation {op}")
        return op

    def dump(self) -> tuple:
        return ([s.at_ms for s in self.snapshots], [s.state for s in self.snapshots], [s.number for s in self.snapshots], self.a, self.b, self.next_number, self.skip)

    @classmethod
    def load(cls, dumped: tuple) -> History:
        at, states, numbers, a, b, n, skip = dumped
        return cls([Snapshot(*x) for x in zip(at, states, numbers, strict=True)], a, b, n, skip)


STATE = "at array<long>, states array<string>, numbers array<long>, a long, b long, next_number long, skip long"
OUTCOME = "key string, at_ms long, state string, outcome string, kept long"


def _replay(history: History, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r in pdf.sort_values(["at_ms", "seq"]).itertuples():
        op = getattr(r, "op", None) or "record"
        outcome = history.record(int(r.at_ms), r.state) if op == "record" else history.steer(op, r.state)
        rows.append((r.key, r.at_ms, r.state, outcome, len(history.snapshots)))
    return pd.DataFrame(rows, columns=["key", "at_ms", "state", "outcome", "kept"])


def record_batch(events: DataFrame) -> DataFrame:
    """key, at_ms, state, outcome, kept for events (key, at_ms, seq, state, and op if there is anything but recording: record, pin-a, pin-b, suppress,
    clear); each key's events are folded in order, one by one."""
    from .histories import recorded

    return recorded(events)


def _replay_stream(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    history = History.load(state.get) if state.exists else History()
    pdf = pd.concat(list(batches))
    out = _replay(history, pdf)
    state.update(history.dump())
    yield out


def record_stream(events: DataFrame) -> DataFrame:
    """``record_batch`` over a stream; events of a key must arrive in order over micro-batches."""
    return events.groupBy("key").applyInPandasWithState(_replay_stream, OUTCOME, STATE, "append", "NoTimeout")


def apply_fresh(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Results (run_id, signature) with applied: whether the signature is still the run's latest input; others finish unapplied."""
    w = Window.partitionBy("run_id").orderBy(F.col("version").desc())
    latest = inputs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("run_id", F.col("signature").alias("_now"), "active")
    out = results.join(latest, "run_id", "left")
    return out.withColumn("applied", F.coalesce((F.col("signature") == F.col("_now")) & F.col("active"), F.lit(False))).drop("_now", "active")


#: How a run's end leaves its key.
ENDS = {"finish": "idle", "fail": "error", "cancel": "idle"}


def run_states(events: DataFrame) -> DataFrame:
    """key, seq, event, run_id, state after each event: running from a start on, until the first end of the run that was started last.

    Ends of other runs, and events without a run, change nothing. Two windows by key; the first end is found within the events behind one start.
    """
    so_far = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_start = F.col("event") == "start"
    out = events.select("key", "seq", "event", "run_id").withColumns({"_at": F.max(F.when(is_start, F.col("seq"))).over(so_far), "_run": F.last(F.when(is_start, F.col("run_id")), ignorenulls=True).over(so_far)})
    end = F.when(F.col("event").isin(*ENDS) & (F.col("run_id") == F.col("_run")), F.col("event"))
    first = F.first(end, ignorenulls=True).over(Window.partitionBy("key", "_at").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    after = F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])
    state = F.when(F.col("_at").isNull(), "idle").when(first.isNull(), "running").otherwise(after[first])
    return out.withColumn("state", state).select("key", "seq", "event", "run_id", "state")


def after_edit(solution: Column) -> Column:
    """Solution state after a manual edit: a solved or stale one becomes modified."""
    return F.when(solution.isin("fitted", "stale"), "modified").otherwise(solution)


def after_normalization(solution: Column) -> Column:
    """Solution state after the normalization changed: a solved one no longer fits."""
    return F.when(solution == "fitted", "stale").otherwise(solution)


def restored(solution: Column, then_fr: Column, then_target: Column, now_fr: Column, now_target: Column) -> Column:
    """A restored solved state is stale if other curves are active now."""
    return F.when((solution == "fitted") & ~(then_fr.eqNullSafe(now_fr) & then_target.eqNullSafe(now_target)), "stale").otherwise(solution)


@dataclass
class EditLog:
    """Undo and redo over immutable values; a new edit clears redo."""

    present: object
    past: list = field(default_factory=list)
    future: list = field(default_factory=list)

    def edit(self, value: object) -> None:
        if value != self.present:
            self.past.append(self.present)
            self.present, self.future = value, []

    def replace(self, value: object) -> None:
        """A change that cannot be undone, such as of the curve list; redo is cleared."""
        self.present, self.future = value, []

    def undo(self) -> None:
        if self.past:
            self.future.append(self.present)
            self.present = self.past.pop()

    def redo(self) -> None:
        if self.future:
            self.past.append(self.present)
            self.present = self.future.pop()


def edit_states(edits: DataFrame) -> DataFrame:
    """key, seq, present, undoable, redoable after each edit (key, seq, op, value): edit, replace, undo or redo; a key's present is null before its first edit."""
    from .histories import edited

    return edited(edits)


def snapshot(state: Column) -> Column:
    """What a snapshot of a workspace struct holds; values are immutable, so the projection is the copy."""
    return F.struct(*[state[n].alias(n) for n in ("filters", "filterProvenance", "solutionState", "autoEqRun", "activeFrId", "activeTargetId")])


def same_state(a: Column, b: Column) -> Column:
    """Equal filters in order with their ids, provenance, solution state and run."""
    out = F.lit(True)
    for n in ("filters", "filterProvenance", "solutionState", "autoEqRun"):
        out &= a[n].eqNullSafe(b[n])
    return out
