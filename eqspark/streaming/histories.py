"""Histories of edits, as streams with state and timers, and the same folds in batch.

A recorder holds a key's snapshots (``History``) and the state that waits for a quiet moment: changes come in bursts, and the last of a burst is recorded ``debounce_ms`` after it.
An edit log holds what may be undone and redone. Both need events in order.

Streams: ``transformWithState``. Events wait in a list until the watermark has passed them, and the earliest sets an event-time timer, so late and unordered events fall into place, and a
burst is recorded by the timer, not by whatever comes next. Events behind the watermark are dropped. A key that is quiet for ``idle_ms`` is forgotten, again by a timer.

Batch: rows are dealt by key and sorted by time within partitions (the sort spills), and a task folds them one by one: it holds one key's snapshots (100 at most), not its
events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .recorder import EditLog, History

OUTCOME = "key string, at_ms long, state string, outcome string, kept long"
EDIT = "key string, seq long, present string, undoable long, redoable long"
#: A stream's events may be this much out of order.
DELAY = "10 seconds"


class Recording:
    """One key: its history, and what waits to be recorded, as (when, state)."""

    columns = ("at_ms", "seq", "op", "state")

    def __init__(self, debounce_ms: int = 0):
        self.history, self.waits, self.debounce_ms = History(), None, debounce_ms

    def step(self, event: tuple) -> list[tuple]:
        """Rows (at_ms, state, outcome, kept) that an event leads to; events come in order."""
        at, _, op, state = event
        out = self.flush(at - 1)
        if (op or "record") == "record":
            self.waits = (at + self.debounce_ms, state)
            return out + (self.flush(at) if not self.debounce_ms else [])
        out += self.flush(at)
        outcome = self.history.steer(op, state)
        return [*out, (at, state, outcome, len(self.history.snapshots))]

    def flush(self, upto: int | None = None) -> list[tuple]:
        """Record what is due by then, or whatever waits."""
        if self.waits is None or (upto is not None and self.waits[0] > upto):
            return []
        (at, state), self.waits = self.waits, None
        outcome = self.history.record(at, state)
        return [(at, state, outcome, len(self.history.snapshots))]

    def due(self) -> int | None:
        """When what waits is to be recorded."""
        return self.waits and self.waits[0]

    def dump(self) -> tuple:
        return (*self.history.dump(), *(self.waits or (None, None)))

    def load(self, dumped: tuple) -> None:
        self.history = History.load(tuple(dumped[:7]))
        self.waits = None if dumped[7] is None else (dumped[7], dumped[8])

    #: What ``dump`` gives.
    state = "at array<long>, states array<string>, numbers array<long>, a long, b long, next_number long, skip long, due long, waits string"


class Editing:
    """One key's edit log."""

    columns = ("at_ms", "seq", "op", "value")
    state = "present string, past array<string>, future array<string>"

    def __init__(self) -> None:
        self.log = EditLog(None)

    def step(self, event: tuple) -> list[tuple]:
        _, seq, op, value = event
        if op in ("undo", "redo"):
            getattr(self.log, op)()
        else:
            getattr(self.log, op)(value)
        return [(seq, self.log.present, len(self.log.past), len(self.log.future))]

    def flush(self, upto: int | None = None) -> list[tuple]:
        return []

    def due(self) -> int | None:
        return None

    def dump(self) -> tuple:
        return self.log.present, list(self.log.past), list(self.log.future)

    def load(self, dumped: tuple) -> None:
        self.log = EditLog(dumped[0], list(dumped[1]), list(dumped[2]))


# --- batch -------------------------------------------------------------------------------------


def _folded(make: Callable[[], Recording | Editing], schema: str):
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

        for b in batches:
            out: list[tuple] = []
            for key, *event in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fold is None or key != now:
                    out += [(now, *r) for r in fold.flush()] if fold else []
                    now, fold = key, make()
                out += [(key, *r) for r in fold.step(tuple(event))]
            yield batch(out)
        if fold:
            yield batch([(now, *r) for r in fold.flush()])

    return run


def _in_order(events: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    own = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows = events.select(F.col("key").cast("string").alias("key"), *own)
    return rows.repartition("key").sortWithinPartitions("key", "at_ms", "seq")


def recorded(events: DataFrame, debounce_ms: int = 0) -> DataFrame:
    """key, at_ms, state, outcome, kept of events (key, at_ms, seq, state, and op if there is anything but recording: record, pin-a, pin-b, suppress, clear)."""
    return _in_order(events, Recording.columns).mapInArrow(_folded(lambda: Recording(debounce_ms), OUTCOME), OUTCOME)


def edited(edits: DataFrame) -> DataFrame:
    """key, seq, present, undoable, redoable after each edit (key, seq, op, value): edit, replace, undo or redo; a key's present is null before its first edit."""
    rows = edits if "at_ms" in edits.columns else edits.withColumn("at_ms", F.col("seq").cast("long"))
    return _in_order(rows, Editing.columns).mapInArrow(_folded(Editing, EDIT), EDIT)


# --- streams -----------------------------------------------------------------------------------


class Ordered(StatefulProcessor):
    """Folds a key's events once the watermark has passed them."""

    def __init__(self, make: Callable[[], Recording | Editing], names: list[str], hold_ms: int, idle_ms: int):
        self.make, self.names, self.hold_ms, self.idle_ms = make, names, hold_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fold = self.make()
        self.handle, self.columns = handle, fold.columns
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {'long' if c in ('at_ms', 'seq') else 'string'}" for c in fold.columns))
        self.held = handle.getValueState("held", fold.state)
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed, columns = timerValues.getCurrentWatermarkInMs(), self.columns
        fresh = [tuple(r[c] for c in columns) for r in rows]
        fresh = [e for e in fresh if not passed or e[0] > passed]  # 0: no watermark yet
        if fresh:
            self.waiting.appendList(fresh)
            times = [e[0] for e in fresh]
            last = max(max(times), self.last.get()[0] if self.last.exists() else 0)
            self.last.update((last,))
            self.handle.registerTimer(min(times) + self.hold_ms)
            self.handle.registerTimer(last + self.hold_ms + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that the watermark has passed is folded at once, so a key's events are read once, not once for each of them
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: (e[0], e[1])) if self.waiting.exists() else []
        ready, later = [e for e in events if e[0] <= upto], [e for e in events if e[0] > upto]
        fold, out = self.make(), []
        if self.held.exists():
            fold.load(tuple(self.held.get()))
        for e in ready:
            out += fold.step(e)
        out += fold.flush(upto)
        if not later and self.last.exists() and upto >= self.last.get()[0] + self.hold_ms + self.idle_ms:
            for s in (self.waiting, self.held, self.last):
                s.clear()
        elif self.last.exists():  # else the key is forgotten already
            if ready:
                self.waiting.put(later) if later else self.waiting.clear()
            self.held.update(fold.dump())
            for at in {*([later[0][0] + self.hold_ms] if later else []), *([fold.due()] if fold.due() is not None else [])}:
                self.handle.registerTimer(at)
        return iter([Row(**dict(zip(self.names, (key[0], *r), strict=True))) for r in out])

    def close(self) -> None:
        pass


def _stream(events: DataFrame, make: Callable[[], Recording | Editing], schema: str, hold_ms: int, delay: str, idle_ms: int) -> DataFrame:
    columns = make().columns
    own = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in columns]
    timed = events.select(F.col("key").cast("string").alias("key"), *own, F.timestamp_millis("at_ms").alias("at")).withWatermark("at", delay)
    names = [x.split()[0] for x in schema.split(", ")]
    return timed.groupBy("key").transformWithState(Ordered(make, names, hold_ms, idle_ms), schema, "Append", "EventTime")


#: A key that is quiet for so long is forgotten.
IDLE_MS = 30 * 24 * 3_600_000


def recorded_stream(events: DataFrame, debounce_ms: int = 0, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """``recorded`` over a stream. The session's state store must be RocksDB (``with_rocksdb``)."""
    return _stream(events, lambda: Recording(debounce_ms), OUTCOME, debounce_ms, delay, idle_ms)


def edited_stream(edits: DataFrame, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """``edited`` over a stream of edits with at_ms."""
    return _stream(edits, Editing, EDIT, 0, delay, idle_ms)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class with_rocksdb:
    """``with with_rocksdb(spark):`` sets the state store that timers and lists need, and restores the setting."""

    def __init__(self, spark) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.was = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_) -> None:
        if self.was is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.was)
