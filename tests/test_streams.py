"""Histories as streams with timers against the same folds in batch."""

import random

import pytest
from pyspark.sql import functions as F

from eqspark.streaming import histories

EVENTS = "key string, at_ms long, seq long, op string, state string"
EDITS = "key string, at_ms long, seq long, op string, value string"


def run_stream(spark, df, parts, make, where):
    """Micro-batches of ``parts`` (conditions), then one far event, whose watermark sets off the last timers."""
    path = str(where / "in")
    far = [("far", 10**9, 10**6, None, "x")]
    for i, part in enumerate([*parts, None]):
        rows = df.where(part) if part else df.sparkSession.createDataFrame(far, df.schema)
        rows.coalesce(1).write.mode("append").parquet(path)
        with histories.with_rocksdb(spark):
            stream = make(spark.readStream.schema(df.schema).parquet(path))
            q = stream.writeStream.format("parquet").option("checkpointLocation", str(where / "mark")).outputMode("append").trigger(availableNow=True).start(str(where / "out"))
            q.awaitTermination()
    return spark.read.parquet(str(where / "out")).where("key <> 'far'")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for k in range(4):
        at = 1000
        for i in range(40):
            at += rng.choice((50, 300, 700, 1500, 6000))
            op = rng.choice(("record",) * 6 + ("pin-a", "pin-b", "suppress", "clear"))
            rows.append((f"k{k}", at, i, op, rng.choice("abcd")))
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("debounce", [0, 500])
def test_recorder_stream_equals_batch(spark, events, debounce, tmp_path):
    """Three micro-batches; within the watermark's delay events come in any order and in the wrong batch."""
    third = F.pmod(F.col("seq") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0), F.lit(100))
    parts = [f"{{}} < 14", f"{{}} >= 14 AND {{}} < 27", f"{{}} >= 27"]
    df = events.withColumn("turn", third)
    cut = [p.replace("{}", "turn") for p in parts]
    frames = {c: df.where(c).drop("turn").collect() for c in cut}
    assert all(frames.values())
    numbered = df.drop("turn")
    conditions = [f"seq + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END {c}" for c in ("< 14", "BETWEEN 14 AND 26", ">= 27")]
    got = run_stream(spark, numbered, conditions, lambda s: histories.recorded_stream(s, debounce, "600 seconds"), tmp_path)
    want = histories.recorded(numbered, debounce)
    assert plain(got) == plain(want) and want.count() > 60


def test_trailing_burst_is_recorded_by_its_timer(spark, tmp_path):
    """Nothing follows the last event of a key, and yet it is recorded, half a second after it; an event behind the watermark is dropped."""
    rows = [("k", 1000, 0, None, "a"), ("k", 1200, 1, None, "b"), ("late", 90_000, 2, None, "z"), ("k", 2000, 3, None, "too late")]
    df = spark.createDataFrame(rows, EVENTS)
    got = run_stream(spark, df, ["seq < 2", "seq = 2", "seq = 3"], lambda s: histories.recorded_stream(s, 500, "1 second"), tmp_path)
    assert plain(got.where("key = 'k'")) == [("k", 1700, "b", "appended", 1)]


def test_idle_keys_are_forgotten(spark, tmp_path):
    rows = [("k", 1000, 0, None, "a"), ("other", 50_000, 1, None, "x"), ("k", 60_000, 2, None, "a")]
    got = run_stream(spark, spark.createDataFrame(rows, EVENTS), ["seq = 0", "seq = 1", "seq = 2"], lambda s: histories.recorded_stream(s, 0, "1 second", 10_000), tmp_path)
    assert plain(got.where("key = 'k'")) == [("k", 1000, "a", "appended", 1), ("k", 60_000, "a", "appended", 1)]  # with its history the second would be the same


def test_edit_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"k{k}", 1000 * (i + 1) + k, i, rng.choice(("edit", "edit", "undo", "redo", "replace")), str(rng.randrange(3))) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, EDITS)
    got = run_stream(spark, df, ["seq % 3 = 1", "seq % 3 = 0", "seq % 3 = 2"], lambda s: histories.edited_stream(s, "3600 seconds"), tmp_path)
    assert plain(got) == plain(histories.edited(df))


def test_batch_of_nothing(spark):
    assert histories.recorded(spark.createDataFrame([], EVENTS)).count() == 0
    assert histories.edited(spark.createDataFrame([], EDITS)).count() == 0
