"""Catalog of equalizer presets: what a library needs to offer its presets for download.

Every preset's filters are put on the steps that a user can type, checked against the product's bounds, audited for filters that work against each other, and
given the headroom of their whole response; then the preset is written as a filter file. Presets with equal filters (whatever their order) point to the first of
their month. The catalog is Parquet, partitioned by month; a second table counts presets by month.

A run takes all months, and replaces the catalog, or those of a range (``from_month``, ``to_month`` of the config, as ``2024-01``, both included), and replaces their partitions
alone. Either way a rerun gives the same tables.

One shuffle brings a preset's filters and its order together; quantization, audit and texts stay there. A preset is one row from the audit on, and its response is an
array that never leaves its task.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eqspark.functions.text import preset_name
from eqspark.operators import filters as ops
from eqspark.operators import grids, presets, ranking
from eqspark.schema import MAX_HZ, MIN_HZ
from eqspark.session import ship
from eqspark.sources import bridge, filter_text

log = logging.getLogger("jobs.preset_catalog")

CATALOG = "preset_id long, owner long, name string, filter_count long, enabled long, valid boolean, preamp_db double, boost_db double, moderate long, strong long, sig string, twin_of long, text string, month string"
MONTHS = "presets long, owners long, twins long, invalid long, conflicted long, least_preamp_db double, month string"


def config(path: str | None = None) -> dict:
    """The job's settings; without a path those beside this file."""
    return json.loads(Path(path or Path(__file__).with_suffix(".json")).read_text())


def chosen(orders: DataFrame, settings: dict) -> DataFrame:
    """preset_id, owner, name, month of the presets of the asked months; the range is a filter on the date, which the scan takes."""
    when = F.col("o_orderdate")
    rows = orders
    if settings.get("from_month"):
        rows = rows.where(when >= F.lit(f"{settings['from_month']}-01").cast("timestamp"))
    if settings.get("to_month"):
        rows = rows.where(when < F.add_months(F.lit(f"{settings['to_month']}-01").cast("date"), 1).cast("timestamp"))
    name = preset_name(F.concat(F.lit(f"{settings['product']} "), F.col("o_orderkey"), F.lit(" "), F.coalesce("o_orderpriority", F.lit(""))))
    return rows.select(F.col("o_orderkey").alias("preset_id"), F.col("o_custkey").alias("owner"), name.alias("name"), F.coalesce(F.date_format(when, "yyyy-MM"), F.lit("none")).alias("month"))


def headroom(boost: Column) -> Column:
    """The preamp that takes a boost back, on its step; what is above a step by a millionth of it counts as on it."""
    return -F.ceil(boost * 10 - 1e-6) / 10 + F.lit(0.0)


def catalog(filters: DataFrame, heads: DataFrame, settings: dict) -> DataFrame:
    """A row for each of ``heads`` that has filters. Filters are met once: lines and key are made where they are packed, and the order comes to the packed row."""
    grid = grids.log_grid(MIN_HZ, MAX_HZ, settings["places_an_octave"])
    if settings.get("from_month") or settings.get("to_month"):
        filters = filters.join(heads.select("preset_id"), "preset_id", "left_semi")
    own = ops.quantize_half_up(filters)
    fine = F.min(F.coalesce(ops.valid_filter(), F.lit(False))).alias("fine")
    packed = presets.packed(own, F.count(F.lit(1)).alias("filter_count"), fine, filter_text.gathered_lines("lines"), ranking.gathered_key("parts"))
    keyed = packed.withColumn("sig", ranking.key_of("parts")).drop("parts")
    audit = presets.audited(keyed, grid, settings["least_score"])
    level = presets.severities(audit, "filter_count", "fine", "boost_db", "lines", "sig")
    rows = level.withColumns({"valid": F.col("fine") & (F.col("filter_count") <= ops.HARD_MAX_FILTERS), "preamp_db": headroom(F.col("boost_db")), "boost_db": F.round("boost_db", 6) + F.lit(0.0)})
    whole = heads.join(rows.withColumn("text", filter_text.file_text(F.col("preamp_db"), "lines")).drop("lines"), "preset_id")
    first = F.min("preset_id").over(Window.partitionBy("month", "sig"))
    names = [x.split(" ")[0] for x in CATALOG.split(", ")]
    return whole.withColumn("first", first).withColumn("twin_of", F.when(F.col("first") != F.col("preset_id"), F.col("first"))).select(*names)


def by_month(table: DataFrame) -> DataFrame:
    """Counts of each month of the catalog."""
    return table.groupBy("month").agg(
        F.count(F.lit(1)).alias("presets"),
        F.count_distinct("owner").alias("owners"),
        F.count("twin_of").alias("twins"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("strong") > 0).alias("conflicted"),
        F.min("preamp_db").alias("least_preamp_db"),
    ).select(*[x.split(" ")[0] for x in MONTHS.split(", ")])


def run(spark: SparkSession, tables: str, output: str, settings: dict | None = None) -> dict[str, int]:
    """Write the catalog and its months. Returns how many presets each month written has."""
    settings = settings or config()
    ship(spark)
    where = output.rstrip("/")
    ranged = bool(settings.get("from_month") or settings.get("to_month"))
    heads = chosen(bridge.table(spark, tables, "orders"), settings)
    rows = catalog(bridge.filters(spark, tables), heads, settings)
    log.info("reading orders and lineitem of %s%s", tables, f", {settings.get('from_month')} to {settings.get('to_month')}" if ranged else "")

    def write(df: DataFrame, name: str) -> None:
        # a range replaces its own partitions; a run over everything also drops months that are no longer there
        mode = "dynamic" if ranged else "static"
        df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month").parquet(f"{where}/{name}")

    write(rows, "presets")
    done = spark.read.schema(CATALOG).parquet(f"{where}/presets")
    if settings.get("from_month"):
        done = done.where(F.col("month") >= settings["from_month"])
    if settings.get("to_month"):
        done = done.where(F.col("month") <= settings["to_month"])
    write(by_month(done), "months")
    counts = {r.month: r.presets for r in spark.read.schema(MONTHS).parquet(f"{where}/months").select("month", "presets").collect()}  # a row a month
    log.info("wrote %d presets of %d months to %s", sum(counts.values()), len(counts), where)
    return counts


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--tables", required=True, help="the folder with orders and lineitem")
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", help="a JSON file; preset_catalog.json beside the job by default")
    parser.add_argument("--from-month")
    parser.add_argument("--to-month")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = config(given.config) | {k: v for k, v in (("from_month", given.from_month), ("to_month", given.to_month)) if v}
    spark = SparkSession.builder.appName("preset_catalog").getOrCreate()
    try:
        run(spark, given.tables, given.output, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
