"""Filter text files of parametric equalizers: reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FILTER_LABELS, TYPE_OF_LABEL, fixed, preset_name
from ..schema import HARD_MAX_FILTERS, MAX_GAIN_DB, MAX_HZ, MAX_Q, MIN_HZ, MIN_Q, STEP_DB, STEP_HZ, STEP_Q

# The file format's lines.
STARTS = r"(?i)^Filter\s*(?:\d+\s*)?:"
LINE = r"(?i)^Filter\s*\d+:\s*(\S+)\s+(\S+)\s+Fc\s*(\S+)\s*Hz\s*Gain\s*(\S+)\s*dB(?:\s*Q\s*(\S+))?\s*$"
DEFAULT_SHELF_Q = 0.707
#: A matched line as its parts behind marks that no line of text holds.
MARK = "\x01"
MARKED = MARK + MARK.join(f"${i}" for i in range(1, 6))


def parse_filters(texts: DataFrame, key: str = "preset_id") -> DataFrame:
    """key, ordinal (from 0), enabled, type, f, gain, q and error columns of every filter line; a text's first bad line is its error.

    A text without filter lines, or with more than 64, has one row that holds the error alone. A text is parsed to an array within its row and
    exploded once; nothing is shuffled.
    """
    rows = read_filters(texts, key)
    rows = rows.select(key, F.col("filter_error").alias("error"), F.posexplode_outer(F.when(F.col("filter_error").isNull(), F.col("filters"))).alias("ordinal", "v"))
    return rows.select(key, "ordinal", (F.col("v.state") == "ON").alias("enabled"), F.col("v.type").alias("type"), F.col("v.f").alias("f"), F.col("v.gain").alias("gain"), F.col("v.q").alias("q"), "error")


def read_filters(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, filter_lines (their number), filters (an array of state, type, f, gain, q, error) and filter_error of each text, one row a text."""
    lines = F.filter(F.transform(F.split("text", r"\r\n?|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(STARTS))
    # one match a line; parsed once: the optimizer does not copy an expression through an explode
    marked = F.transform(lines, lambda x: F.struct(F.split(F.regexp_replace(x, LINE, MARKED), MARK).alias("p")))
    rows = texts.select(*keep, F.explode(F.array(F.transform(marked, lambda v: _line(v["p"])))).alias("filters"))
    errors = F.filter(F.transform("filters", lambda v: v["error"]), lambda e: e.isNotNull())
    error = F.when(F.size("filters") == 0, "parse: no filters").when(F.size(errors) > 0, F.get(errors, F.lit(0))).when(F.size("filters") > HARD_MAX_FILTERS, "validation: more than 64 filters")
    return rows.select(*keep, F.size("filters").alias("filter_lines"), "filters", error.alias("filter_error"))


def _line(parts: Column) -> Column:
    """state, type, f, gain, q and error of a filter line's parts: what the pattern took apart, or the line alone where it did not match."""
    number = lambda s: F.when(s.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), s.try_cast("double"))
    bad = lambda x: x.isNull() | (F.abs(x) == float("inf"))
    fine = F.size(parts) == 6
    part = lambda i: F.get(parts, F.lit(i))
    state, q_text = F.upper(part(1)), part(5)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_OF_LABEL.items() for x in pair]), F.upper(part(2)))
    f, gain = number(part(3)), number(part(4))
    q = F.when(q_text == "", F.lit(DEFAULT_SHELF_Q)).otherwise(number(q_text))

    def judged(v: Column) -> Column:
        error = (
            F.when(~fine, "parse: malformed filter line")
            .when(~v["state"].isin("ON", "OFF"), "parse: unsupported state")
            .when(v["type"].isNull(), "parse: unsupported type")
            .when((v["type"] == "PK") & (q_text == ""), "parse: a peak needs Q")
            .when(bad(v["f"]) | bad(v["gain"]) | bad(v["q"]), "validation: numbers must be finite")
            .when(~v["f"].between(MIN_HZ, MAX_HZ), "validation: frequency out of bounds")
            .when(~v["gain"].between(-MAX_GAIN_DB, MAX_GAIN_DB), "validation: gain out of bounds")
            .when(~v["q"].between(MIN_Q, MAX_Q), "validation: Q out of bounds")
        )
        return F.struct(*[v[n].alias(n) for n in ("state", "type", "f", "gain", "q")], error.alias("error"))

    # each number is read once: the second step sees the first one's results
    read = F.struct(state.alias("state"), kind.alias("type"), f.alias("f"), gain.alias("gain"), q.alias("q"))
    return F.get(F.transform(F.array(read), judged), F.lit(0))


def gathered_lines(name: str) -> Column:
    """The lines of a filter set's enabled filters, as an aggregate of its filters; they get their numbers in ``file_text``."""
    label = F.create_map(*[F.lit(x) for pair in FILTER_LABELS.items() for x in pair])[F.col("type")]
    line = F.concat(F.lit(": ON "), label, F.lit(" Fc "), fixed(F.col("f"), 0), F.lit(" Hz Gain "), fixed(F.col("gain"), 1, True), F.lit(" dB Q "), fixed(F.col("q"), 3))
    return F.collect_list(F.when(F.col("enabled"), F.struct("ordinal", line.alias("line")))).alias(name)


def file_text(preamp_db: Column, name: str) -> Column:
    """The file of what ``gathered_lines`` gathered: the preamp and the enabled filters, numbered anew, lines ending CR LF but for the last."""
    first = F.concat(F.lit("Preamp: "), fixed(preamp_db, 1, True), F.lit(" dB"))
    return F.concat_ws("\r\n", first, F.transform(F.sort_array(name), lambda v, i: F.concat(F.lit("Filter "), i + 1, v["line"])))


def format_filters(filters: DataFrame, preamps: DataFrame) -> DataFrame:
    """preset_id, text: the preamp and the enabled filters, numbered anew, lines ending CR LF but for the last."""
    label = F.create_map(*[F.lit(x) for pair in FILTER_LABELS.items() for x in pair])[F.col("type")]
    on = filters.where("enabled").withColumn("n", F.row_number().over(Window.partitionBy("preset_id").orderBy("ordinal")))
    line = F.concat(F.lit("Filter "), F.col("n"), F.lit(": ON "), label, F.lit(" Fc "), fixed(F.col("f"), 0), F.lit(" Hz Gain "), fixed(F.col("gain"), 1, True), F.lit(" dB Q "), fixed(F.col("q"), 3))
    per = on.groupBy("preset_id").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("x"))
    first = F.concat(F.lit("Preamp: "), fixed(F.col("preamp_db"), 1, True), F.lit(" dB"))
    return preamps.join(per, "preset_id", "left").select("preset_id", F.concat_ws("\r\n", first, F.transform("x", lambda v: v["line"])).alias("text"))


def on_step(value: Column, step: float) -> Column:
    """Whether a value is a multiple of ``step`` but for rounding."""
    n = value / step
    return F.abs(n - F.floor(n + 0.5)) <= F.greatest(F.lit(1.0), F.abs(n)) * (2.0**-52 * 64)


def format_manual_entry(filters: DataFrame, presets: DataFrame, product: str = "eqspark") -> DataFrame:
    """preset_id, text, error: the strict text for typing into an equalizer; ``presets`` has preset_id, name, preamp_db.

    Enabled filters must be within bounds and on steps; a name must hold something and no line break.
    """
    return _manual_texts(presets.join(_manual_lines(filters), "preset_id", "left"), F.col("name"), F.col("preamp_db"), product)


def format_manual_alike(filters: DataFrame, name: Column, preamp_db: Column, product: str = "eqspark") -> DataFrame:
    """``format_manual_entry`` of all presets that have filters, with expressions of the preset_id for their names and preamps: filters are met once, and nothing is joined."""
    return _manual_texts(_manual_lines(filters), name, preamp_db, product)


def _manual_lines(filters: DataFrame) -> DataFrame:
    """preset_id, x (the enabled filters' lines, without their numbers, in order), fine, count; a place in the array is a filter's number."""
    fine = F.col("f").between(MIN_HZ, MAX_HZ) & F.col("gain").between(-MAX_GAIN_DB, MAX_GAIN_DB) & F.col("q").between(MIN_Q, MAX_Q) & on_step(F.col("f"), STEP_HZ) & on_step(F.col("gain"), STEP_DB) & on_step(F.col("q"), STEP_Q)
    label = F.create_map(*[F.lit(x) for pair in FILTER_LABELS.items() for x in pair])[F.col("type")]
    line = F.concat(F.lit(": ON "), label, F.lit(" Fc "), fixed(F.col("f"), 0), F.lit(" Hz Gain "), fixed(F.col("gain"), 1), F.lit(" dB Q "), fixed(F.col("q"), 2))
    on = F.col("enabled")
    lines = F.sort_array(F.collect_list(F.when(on, F.struct("ordinal", line.alias("line")))))
    return filters.groupBy("preset_id").agg(lines.alias("x"), F.min(F.when(on, fine)).alias("fine"), F.count_if(on).alias("count"))


def _manual_texts(out: DataFrame, name: Column, preamp_db: Column, product: str) -> DataFrame:
    error = F.when(name.rlike(r"[\r\n]") | (preset_name(name) == ""), "export: bad name").when(~F.coalesce("fine", F.lit(True)), "export: a filter is out of bounds or off its steps").when(F.coalesce("count", F.lit(0)) > HARD_MAX_FILTERS, "export: more than 64 filters").when(~on_step(preamp_db, 0.1), "export: preamp off its step")
    head = F.array(F.lit(f"# {product} preset"), F.concat(F.lit("# "), name), F.concat(F.lit("Preamp: "), fixed(preamp_db, 1), F.lit(" dB")))
    text = F.concat_ws("\n", head, F.transform("x", lambda v, i: F.concat(F.lit("Filter "), i + 1, v["line"])))
    return out.select("preset_id", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def format_graphic(points: DataFrame) -> DataFrame:
    """preset_id, text of graphic-EQ points (preset_id, f, gain)."""
    item = F.concat(F.col("f").cast("long"), F.lit(" "), fixed(F.col("gain"), 1, True))
    per = points.groupBy("preset_id").agg(F.sort_array(F.collect_list(F.struct("f", item.alias("t")))).alias("x"))
    return per.select("preset_id", F.concat(F.lit("GraphicEQ: "), F.concat_ws("; ", F.transform("x", lambda v: v["t"]))).alias("text"))


def format_graphic_items(presets: DataFrame) -> DataFrame:
    """preset_id, text of presets whose points are an array of texts (``operators.filters.graphic_items``)."""
    return presets.select("preset_id", F.concat(F.lit("GraphicEQ: "), F.concat_ws("; ", "items")).alias("text"))
