"""Curve text files: cleaning, delimiter choice, rows, duplicates. Errors are columns (category and message), or raised in strict reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as a number in a file; the words pass here and fail as not finite.
NUMBER = r"(?i)^[+-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?|Infinity|NaN)$"
DELIMITERS = {"tab": "\t", "semicolon": ";", "comma": ",", "whitespace": r"[ \f\x0B]+"}
BLANK = r"[\s\x{FEFF}\x{A0}]"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def clean_lines(text: Column) -> Column:
    """Trimmed lines without blank lines and comments (``#``, ``//``, and ``;`` with a space after it)."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"^\x{FEFF}", ""), r"\r\n?", "\n"), "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(rf"^{BLANK}*($|#|//|; )"))
    return F.transform(kept, lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", ""))


def columns_of(line: Column, pattern: str) -> Column:
    return F.transform(F.split(line, pattern), lambda c: F.trim(c))  # a bare F.trim would take the place as its second argument


def is_number(token: Column) -> Column:
    return token.rlike(NUMBER)


def is_header(columns: Column) -> Column:
    """Two columns that hold something, neither a number."""
    return (F.size(columns) == 2) & F.forall(columns, lambda c: (F.length(c) > 0) & ~is_number(c))


def data_lines(lines: Column, pattern: str) -> Column:
    """Lines behind at most one header; only the first line is looked at."""
    head = F.exists(F.transform(F.slice(lines, 1, 1), lambda x: columns_of(x, pattern)), is_header)
    return F.slice(lines, F.when(head, 2).otherwise(1), F.size(lines))


def data_rows(lines: Column, pattern: str) -> Column:
    """Columns of each line behind at most one header."""
    return F.transform(data_lines(lines, pattern), lambda x: columns_of(x, pattern))


def matches(lines: Column, pattern: str) -> Column:
    """Every data row is two numbers. A line is taken apart once, and none behind the first that is not."""
    two = lambda r: (F.size(r) == 2) & F.forall(r, is_number)
    return F.forall(data_lines(lines, pattern), lambda x: F.exists(F.array(columns_of(x, pattern)), two))


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with columns that later expressions read as they are: the optimizer copies no expression through an explode."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("_s")).select(*[F.col(f"_s.{c}").alias(c) for c in columns])


def parse_curves(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, delimiter, points (rising, duplicates once), error_category, error_message of each text.

    Everything is an array expression within a row: a file is one row, and nothing is shuffled.
    """
    return parse_lines(once(texts.select(key, clean_lines(F.col("text")).alias("lines")), key, "lines"), key)


def parse_lines(out: DataFrame, key: str = "path") -> DataFrame:
    """``parse_curves`` of texts whose ``clean_lines`` are at hand as ``lines``."""
    fits = F.array(*[F.when(matches(F.col("lines"), p), F.lit(n)) for n, p in DELIMITERS.items()])
    out = out.withColumn("found", F.filter(fits, lambda x: x.isNotNull()))
    chosen = F.lit(None).cast("array<array<string>>")
    for n, p in DELIMITERS.items():
        chosen = F.when(F.get("found", F.lit(0)) == n, data_rows(F.col("lines"), p)).otherwise(chosen)
    out = once(out.withColumn("rows", F.when(F.size("found") == 1, chosen)), key, "lines", "found", "rows")
    number = lambda s: F.when(s.rlike(r"(?i)infinity|nan"), F.lit(None)).otherwise(s.try_cast("double"))
    points = F.transform("rows", lambda r: F.struct(number(r[0]).alias("frequency_hz"), number(r[1]).alias("db")))
    out = once(out.withColumn("points", points), key, "lines", "found", "points")
    finite = F.forall("points", lambda p: p["frequency_hz"].isNotNull() & p["db"].isNotNull() & (F.abs(p["frequency_hz"]) < float("inf")) & (F.abs(p["db"]) < float("inf")))
    positive = F.forall("points", lambda p: p["frequency_hz"] > 0)
    unique = F.array_sort(F.array_distinct("points"))
    distinct_f = F.size(F.array_distinct(F.transform("points", lambda p: p["frequency_hz"])))
    out = once(out.withColumn("unique", unique), key, "lines", "found", "points", "unique")
    error = (
        F.when(F.size("lines") == 0, F.struct(F.lit("validation").alias("c"), F.lit("no numeric data").alias("m")))
        .when(F.size("found") == 0, F.struct(F.lit("parse").alias("c"), F.lit("malformed rows or columns").alias("m")))
        .when(F.size("found") > 1, F.struct(F.lit("parse").alias("c"), F.lit("ambiguous delimiter").alias("m")))
        .when(~finite, F.struct(F.lit("validation").alias("c"), F.lit("numbers must be finite").alias("m")))
        .when(~positive, F.struct(F.lit("validation").alias("c"), F.lit("frequencies must be positive").alias("m")))
        .when(F.size("unique") != distinct_f, F.struct(F.lit("validation").alias("c"), F.lit("a frequency has conflicting levels").alias("m")))
        .when(F.size("unique") < 2, F.struct(F.lit("validation").alias("c"), F.lit("two points at least are needed").alias("m")))
    )
    out = once(out.withColumn("error", error), key, "found", "unique", "error")
    return out.select(key, F.when(F.col("error").isNull(), F.get("found", F.lit(0))).alias("delimiter"), F.when(F.col("error").isNull(), F.col("unique")).alias("points"), F.col("error.c").alias("error_category"), F.col("error.m").alias("error_message"))


def strict(parsed: DataFrame) -> DataFrame:
    """Reading a bad text raises."""
    message = F.concat_ws(": ", "error_category", "error_message")
    return parsed.withColumn("points", F.when(F.col("error_category").isNull(), F.col("points")).otherwise(F.raise_error(message)))


def curve_points(parsed: DataFrame, key: str = "path") -> DataFrame:
    """Long form: curve_id (a hash of the key), idx, f, db."""
    good = parsed.where("error_category IS NULL").select(F.sha2(F.col(key).cast("string"), 256).alias("curve_id"), F.posexplode("points").alias("idx", "p"))
    return good.select("curve_id", "idx", F.col("p.frequency_hz").alias("f"), F.col("p.db").alias("db"))
