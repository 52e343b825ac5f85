"""Incremental import of measurement and filter texts.

Every text is cleaned and read as a curve (two columns of numbers) or as a parametric-equalizer file, and gets a verdict: ``curve``, ``filters`` or ``rejected``
with the reader's error. Accepted points and filters are kept beside the verdict as arrays, in one table that is partitioned by verdict and batch; a
report counts texts by origin, verdict and error.

Inputs are tables with the same columns (``config``: id, text, carried columns), each under a name of its own, its origin. They are read as file streams with a checkpoint: a run takes the files that are new since
the last one and ends (availableNow). A text is known by origin, id and SHA-256. One that an earlier batch has, as when a table is exported anew with some rows more, is not taken again; the same
id with another text is a new version, and stays beside the old one.

Reruns and crashes: a batch writes its own partitions alone, with dynamic overwrite, and leaves out what other batches hold, so a batch that is delivered twice
replaces itself. Losing the checkpoint but not the output costs a pass over the inputs and changes nothing. The report is made anew from the table.
"""

from __future__ import annotations

import argparse
import json
import logging
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eqspark.session import ship
from eqspark.sources import curve_text, filter_text

log = logging.getLogger("jobs.import_texts")

POINTS = "array<struct<frequency_hz:double,db:double>>"
FILTERS = "array<struct<enabled:boolean,type:string,f:double,gain:double,q:double>>"
KEY = ["origin", "id", "digest"]
REPORT = "origin string, verdict string, category string, message string, texts long, lines long, points long, filters long"


def config(path: str | None = None) -> dict:
    """The job's settings; without a path those beside this file."""
    return json.loads(Path(path or Path(__file__).with_suffix(".json")).read_text())


def schema(settings: dict) -> str:
    carried = "".join(f"{c} string, " for c in settings["carry"])
    return f"origin string, id string, digest string, {carried}n_lines long, first_lines array<string>, category string, message string, delimiter string, points {POINTS}, filters {FILTERS}, verdict string, batch long"


def keyed(texts: DataFrame) -> DataFrame:
    """``texts`` (origin, id, text, carried columns) with their digest; a null text is empty."""
    return texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.sha2("text", 256))


def judged(texts: DataFrame, settings: dict) -> DataFrame:
    """``keyed`` texts with verdict, error, and what was read. Everything is an expression within a row."""
    rows = curve_text.once(texts.withColumn("lines", curve_text.clean_lines(F.col("text"))), *KEY, *settings["carry"], "text", "lines")
    told = [F.size("lines").cast("long").alias("n_lines"), F.slice("lines", 1, settings["kept_lines"]).alias("first_lines")]
    curves = curve_text.parse_lines(rows.select(F.struct(*KEY, *settings["carry"], "text", *told).alias("own"), "lines"), "own")
    read = filter_text.read_filters(curves.withColumn("text", F.col("own.text")), *curves.columns)
    is_curve, is_filters = F.col("error_category").isNull(), F.col("filter_error").isNull()
    told: Column = F.when(F.col("filter_lines") > 0, F.col("filter_error")).otherwise(F.concat_ws(": ", "error_category", "error_message"))
    told = F.when(~is_curve & ~is_filters, told)
    verdict = F.when(is_curve, "curve").when(is_filters, "filters").otherwise("rejected")
    return read.select(
        *[F.col(f"own.{c}").alias(c) for c in [*KEY, *settings["carry"], "n_lines", "first_lines"]],
        F.substring_index(told, ": ", 1).alias("category"),
        F.substring(told, F.instr(told, ": ") + 2, F.length(told)).alias("message"),
        "delimiter",
        "points",
        F.when(~is_curve & is_filters, F.transform("filters", lambda v: F.struct((v["state"] == "ON").alias("enabled"), *[v[n].alias(n) for n in ("type", "f", "gain", "q")]))).alias("filters"),
        verdict.alias("verdict"),
    )


def as_pattern(path: str) -> str:
    """``path`` as a pattern that it alone matches: a file stream takes a folder or a pattern, and a table may be one file."""
    path = path.rstrip("/")
    return path if re.search(r"[*?\[{]", path) else f"{path[:-1]}[{path[-1]}]"


def stream(spark: SparkSession, inputs: dict[str, str], settings: dict) -> DataFrame:
    """origin, id, text and carried columns of all inputs as one stream. Columns that an input lacks are null."""
    out = None
    for origin, path in inputs.items():
        shape = spark.read.parquet(path).schema
        has = {f.name for f in shape.fields}
        column = lambda c: (F.col(c) if c in has else F.lit(None)).cast("string").alias(c)  # noqa: B023, E731
        files = spark.readStream.schema(shape).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(as_pattern(path))
        own = files.select(F.lit(origin).alias("origin"), F.col(settings["id"]).cast("string").alias("id"), F.col(settings["text"]).cast("string").alias("text"), *[column(c) for c in settings["carry"]])
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no input")
    return out


def write_batch(batch: DataFrame, number: int, table: str, settings: dict) -> None:
    """Judge what no other batch holds, and put it into this batch's partitions. Texts are told apart before they are judged, so a text is judged once, and its row of arrays is not shuffled."""
    spark = batch.sparkSession
    held = spark.read.schema(schema(settings)).parquet(table).where(F.col("batch") != number).select(*[F.col(c).alias(f"_{c}") for c in KEY])
    rows = keyed(batch).dropDuplicates(KEY)
    same = F.lit(True)
    for c in KEY:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    fresh = judged(rows.join(held, same, "left_anti"), settings).withColumn("batch", F.lit(number).cast("long"))
    names = [x.split(" ")[0] for x in schema(settings).split(", ")]
    fresh.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("verdict", "batch").parquet(table)
    log.info("batch %d written to %s", number, table)


def run(spark: SparkSession, inputs: dict[str, str], output: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Import what is new. Returns the texts of each verdict in the whole table."""
    settings = settings or config()
    ship(spark)
    table, report = f"{output.rstrip('/')}/texts", f"{output.rstrip('/')}/report"
    # so that the table can be read before its first batch
    spark.createDataFrame([], schema(settings)).write.mode("append").partitionBy("verdict", "batch").parquet(table)
    query = stream(spark, inputs, settings).writeStream.foreachBatch(lambda df, n: write_batch(df, n, table, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new rows of %s", read, ", ".join(f"{k} ({v})" for k, v in inputs.items()))
    counts = summary(spark.read.schema(schema(settings)).parquet(table))
    counts.coalesce(1).write.mode("overwrite").parquet(report)
    verdicts = {r.verdict: r.n for r in spark.read.schema(REPORT).parquet(report).groupBy("verdict").agg(F.sum("texts").alias("n")).collect()}  # three rows at most
    log.info("%s holds %s", table, verdicts)
    return verdicts


def summary(table: DataFrame) -> DataFrame:
    """Texts, lines, points and filters by origin, verdict and error."""
    size = lambda c: F.sum(F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long"))
    per = table.groupBy("origin", "verdict", "category", "message")
    return per.agg(F.count(F.lit(1)).alias("texts"), F.sum("n_lines").alias("lines"), size("points").alias("points"), size("filters").alias("filters"))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--input", action="append", required=True, metavar="NAME=PATH", help="a Parquet table of texts; may be given more than once")
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--config", help="a JSON file; import_texts.json beside the job by default")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("import_texts").getOrCreate()
    try:
        run(spark, dict(x.split("=", 1) for x in given.input), given.output, given.checkpoint, config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
