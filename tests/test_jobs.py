"""The two jobs over growing and changed input, on copies."""

import json

import pytest
from pyspark.sql import functions as F

from jobs import import_texts, preset_catalog
from jobs import queries as jobs

from .oracle import DATA, connection, rows

CURVE = "frequency\tdB\n20\t1.5\n100\t-2\n20000\t0\n"
PRESET = "Preamp: -6.0 dB\nFilter 1: ON PK Fc 100 Hz Gain -3.0 dB Q 1.00\nFilter 2: OFF LSC Fc 80 Hz Gain 2.0 dB\n"


@pytest.mark.parametrize("name", sorted(jobs.oracle_sql()))
def test_job_equals_oracle(spark, name):
    got = jobs.queries()[name](spark, DATA).toPandas()
    want = connection().execute(jobs.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def texts(spark, items, path):
    spark.createDataFrame([(i, t, "en", "a") for i, t in items], "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(path)


def table(spark, out):
    settings = import_texts.config()
    return spark.read.schema(import_texts.schema(settings)).parquet(f"{out}/texts")


def seen(spark, out):
    return sorted((r.id, r.verdict, r.category, r.message, len(r.points or []), len(r.filters or [])) for r in table(spark, out).select("id", "verdict", "category", "message", "points", "filters").collect())


FIRST = [(1, CURVE), (2, PRESET), (3, "some prose of\nseveral words"), (4, None), (5, "20;1\n20;2\n"), (6, "Filter 1: ON PK Fc 100 Hz Gain 99 dB Q 1\n")]
FOUND = [
    ("1", "curve", None, None, 3, 0),
    ("2", "filters", None, None, 0, 2),
    ("3", "rejected", "parse", "malformed rows or columns", 0, 0),
    ("4", "rejected", "validation", "no numeric data", 0, 0),
    ("5", "rejected", "validation", "a frequency has conflicting levels", 0, 0),
    ("6", "rejected", "validation", "gain out of bounds", 0, 0),
]


def test_import_takes_only_what_is_new(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("inbox", "out", "mark"))
    texts(spark, FIRST, inbox)
    assert import_texts.run(spark, {"in": inbox}, out, mark) == {"curve": 1, "filters": 1, "rejected": 4}
    assert seen(spark, out) == FOUND
    assert import_texts.run(spark, {"in": inbox}, out, mark) == {"curve": 1, "filters": 1, "rejected": 4}  # nothing new
    assert seen(spark, out) == FOUND
    # the table is exported anew with one row more, one changed, and one twice
    texts(spark, [*FIRST, (7, CURVE), (7, CURVE), (3, CURVE.replace("1.5", "2.5"))], inbox)
    assert import_texts.run(spark, {"in": inbox}, out, mark) == {"curve": 3, "filters": 1, "rejected": 4}
    assert seen(spark, out) == sorted([*FOUND, ("7", "curve", None, None, 3, 0), ("3", "curve", None, None, 3, 0)], key=str)
    by_batch = {r.batch: r.n for r in table(spark, out).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by_batch == {0: 6, 1: 2}
    report = {(r.verdict, r.message): (r.texts, r.points, r.filters) for r in spark.read.schema(import_texts.REPORT).parquet(f"{out}/report").collect()}
    assert report[("curve", None)] == (3, 9, 0) and report[("filters", None)] == (1, 0, 2) and sum(x[0] for x in report.values()) == 8


def test_import_in_parts_equals_import_at_once(spark, tmp_path):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    parts, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    documents.where("doc_id % 2 = 0").write.parquet(parts)
    import_texts.run(spark, {"d": parts}, str(tmp_path / "a"), str(tmp_path / "a-mark"))
    documents.where("doc_id % 2 = 1").write.mode("append").parquet(parts)
    import_texts.run(spark, {"d": parts}, str(tmp_path / "a"), str(tmp_path / "a-mark"))
    documents.write.parquet(whole)
    import_texts.run(spark, {"d": whole}, str(tmp_path / "b"), str(tmp_path / "b-mark"))
    assert seen(spark, tmp_path / "a") == seen(spark, tmp_path / "b") and len(seen(spark, tmp_path / "a")) == documents.count()


def test_import_batch_delivered_twice(spark, tmp_path):
    """A batch whose write ended but whose checkpoint did not comes again: it replaces its own partitions."""
    out, settings = str(tmp_path / "out"), import_texts.config()
    spark.createDataFrame([], import_texts.schema(settings)).write.partitionBy("verdict", "batch").parquet(f"{out}/texts")
    batch = spark.createDataFrame([("in", str(i), t, "en", "a") for i, t in FIRST], "origin string, id string, text string, lang string, source string")
    for _ in range(2):
        import_texts.write_batch(batch, 0, f"{out}/texts", settings)
    assert seen(spark, out) == FOUND
    import_texts.write_batch(batch, 1, f"{out}/texts", settings)  # the same texts in a later batch
    assert seen(spark, out) == FOUND


def test_import_after_a_lost_checkpoint(spark, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    texts(spark, FIRST[:3], inbox)
    texts(spark, FIRST[3:], inbox)
    settings = import_texts.config() | {"files_per_batch": 1}
    import_texts.run(spark, {"in": inbox}, out, str(tmp_path / "mark"), settings)
    assert table(spark, out).select("batch").distinct().count() == 2
    import_texts.run(spark, {"in": inbox}, out, str(tmp_path / "new-mark"), settings)
    assert seen(spark, out) == FOUND


def test_import_of_nothing(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    texts(spark, [], inbox)
    assert import_texts.run(spark, {"in": inbox}, str(tmp_path / "out"), str(tmp_path / "mark")) == {}
    assert seen(spark, tmp_path / "out") == []


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    return where


def presets_of(spark, out):
    return {r.preset_id: r for r in spark.read.schema(preset_catalog.CATALOG).parquet(f"{out}/presets").collect()}


def test_catalog_of_a_range_replaces_its_months_alone(spark, copies, tmp_path):
    out, settings = str(tmp_path / "out"), preset_catalog.config()
    counts = preset_catalog.run(spark, copies, out, settings)
    whole = presets_of(spark, out)
    assert sum(counts.values()) == len(whole)
    month = sorted(counts)[1]
    again = preset_catalog.run(spark, copies, out, settings | {"from_month": month, "to_month": month, "product": "renamed"})
    assert again == counts
    after = presets_of(spark, out)
    assert after.keys() == whole.keys()
    for k, r in after.items():
        assert r.asDict() | {"name": None} == whole[k].asDict() | {"name": None}
        assert r.name.startswith("renamed" if r.month == month else "eqspark")
    assert preset_catalog.run(spark, copies, out, settings) == counts and presets_of(spark, out) == whole


def test_catalog_of_new_orders(spark, copies, tmp_path):
    """More orders come: a run over their months makes what a run over everything makes."""
    grown, some, all_ = (str(tmp_path / x) for x in ("grown", "some", "all"))
    orders = spark.read.parquet(f"{copies}/orders.parquet")
    last = orders.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM")).first()[0]
    early = F.date_format("o_orderdate", "yyyy-MM") < last
    spark.read.parquet(f"{copies}/lineitem.parquet").write.parquet(f"{grown}/lineitem.parquet")
    orders.where(early).write.parquet(f"{grown}/orders.parquet")
    preset_catalog.run(spark, grown, some)
    assert last not in {r.month for r in presets_of(spark, some).values()}
    orders.where(~early).write.mode("append").parquet(f"{grown}/orders.parquet")
    preset_catalog.run(spark, grown, some, preset_catalog.config() | {"from_month": last})
    preset_catalog.run(spark, grown, all_)
    assert presets_of(spark, some) == presets_of(spark, all_)


def test_catalog_drops_months_that_are_gone(spark, copies, tmp_path):
    fewer, out = str(tmp_path / "fewer"), str(tmp_path / "out")
    preset_catalog.run(spark, copies, out)
    spark.read.parquet(f"{copies}/lineitem.parquet").write.parquet(f"{fewer}/lineitem.parquet")
    orders = spark.read.parquet(f"{copies}/orders.parquet")
    orders.where("o_orderdate < '1998-01-01'").write.parquet(f"{fewer}/orders.parquet")
    preset_catalog.run(spark, fewer, out)
    assert {r.month for r in presets_of(spark, out).values()} == {r.m for r in spark.read.parquet(f"{fewer}/orders.parquet").join(spark.read.parquet(f"{fewer}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.date_format("o_orderdate", "yyyy-MM").alias("m")).distinct().collect()}


def test_configs_are_read():
    for job in (import_texts, preset_catalog):
        settings = job.config()
        assert settings and json.dumps(settings)
