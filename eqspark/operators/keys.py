"""Texts that name filters, filter sets, proposals and inputs of a run; unique names. A set is an array of at most 64 filters (id, enabled, type, f, gain, q)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("id", "enabled", "type", "f", "gain", "q")


def number_text(x: Column) -> Column:
    """A number as JSON spells it: no needless fraction, no negative zero."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def quoted(text: Column) -> Column:
    """A text between quotes; quotes and backslashes in it are escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def _object(x: Column, named: bool) -> Column:
    name = [F.lit('"id":'), quoted(x["id"]), F.lit(",")] if named else []
    return F.concat(F.lit("{"), *name, F.lit('"enabled":'), x["enabled"].cast("string"), F.lit(',"type":'), quoted(x["type"]), F.lit(',"frequencyHz":'), number_text(x["f"]), F.lit(',"gainDb":'), number_text(x["gain"]), F.lit(',"q":'), number_text(x["q"]), F.lit("}"))


def _listed(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def type_place(kind: Column) -> Column:
    return F.when(kind == "LS", 0).when(kind == "PK", 1).otherwise(2)


def gathered(filters: DataFrame, group: str = "preset_id") -> DataFrame:
    """group, filters: each set (64 filters at most) as one array by ordinal. A missing id is ``f-`` and the ordinal."""
    name = F.col("id") if "id" in filters.columns else F.concat(F.lit("f-"), F.col("ordinal"))
    rows = filters.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("ordinal", name.alias("id"), "enabled", "type", "f", "gain", "q"))).alias("x"))
    return rows.select(group, F.transform("x", lambda x: F.struct(*[x[c].alias(c) for c in FIELDS])).alias("filters"))


def canonical(filters: Column) -> Column:
    """By type, frequency and id."""
    keyed = F.transform(filters, lambda x: F.struct(type_place(x["type"]).alias("k"), x["f"].alias("kf"), x["id"].alias("ki"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def filter_key(filters: Column, named: bool = True) -> Column:
    """Text of a set, whatever its order; without ids (``named`` false) it is the semantic key."""
    own = lambda x: [x["id"].alias("i")] if named else []
    keyed = F.transform(filters, lambda x: F.struct(type_place(x["type"]).alias("k"), x["f"].alias("f"), x["gain"].alias("g"), x["q"].alias("q"), x["enabled"].alias("e"), *own(x), _object(x, named).alias("t")))
    return _listed(F.transform(F.array_sort(keyed), lambda k: k["t"]))


def proposal_key(mutation: Column, filters: Column) -> Column:
    """Text of a mutation and its filters in their order, without ids."""
    return F.concat(F.lit('{"mutation":'), quoted(mutation), F.lit(',"filters":'), _listed(F.transform(filters, lambda x: _object(x, False))), F.lit("}"))


def trace_key(x: Column) -> Column:
    """Text of one filter as a list of its values."""
    return F.concat(F.lit("["), x["enabled"].cast("string"), F.lit(","), quoted(x["type"]), F.lit(","), number_text(x["f"]), F.lit(","), number_text(x["gain"]), F.lit(","), number_text(x["q"]), F.lit("]"))


def solution_key(filters: Column) -> Column:
    """Text of a list of trace keys, each a text in it."""
    return _listed(F.transform(filters, lambda x: quoted(trace_key(x))))


def unique_names(names: Column) -> Column:
    """Names in order, each as it is or with the first of -1, -2, ... that is not taken yet."""
    tries = lambda name: F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.when(i == 0, name).otherwise(F.concat(name, F.lit("-"), i)))
    return F.aggregate(names, F.array().cast("array<string>"), lambda held, name: F.concat(held, F.array(F.get(F.filter(tries(name), lambda t: ~F.array_contains(held, t)), F.lit(0)))))


def points_text(points: Column) -> Column:
    """[[frequency, dB], ...] of an array of (f, db)."""
    return _listed(F.transform(points, lambda p: F.concat(F.lit("["), number_text(p["f"]), F.lit(","), number_text(p["db"]), F.lit("]"))))


def input_signature(source_id: Column, target_id: Column, source: Column, target: Column, normalization: list[Column], settings: list[Column]) -> Column:
    """Text of all that a run depends on: ids and points of both curves, normalization (mode first) and settings; names do not count. Null if a curve is missing."""
    mode, *level = normalization
    return F.concat(
        F.lit('{"activeFrId":'), quoted(source_id), F.lit(',"activeTargetId":'), quoted(target_id), F.lit(',"sourcePoints":'), points_text(source), F.lit(',"targetPoints":'), points_text(target),
        F.lit(',"normalization":['), quoted(mode), *[F.concat(F.lit(","), number_text(x)) for x in level], F.lit('],"settings":['), F.concat_ws(",", *[number_text(x) for x in settings]), F.lit("]}"),
    )
