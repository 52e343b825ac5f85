"""Recurrences over the arrays of a row as column expressions: banded systems and fixed-point iterations. All are folds, so a row needs no Python and no neighbour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def solve_two_bands(rows: Column) -> Column:
    """The solution (an array) of a symmetric positive system with two bands: ``rows`` is an array of structs (d0, d1, d2, b), the diagonals and the right side.

    d1[i] couples rows i and i + 1, d2[i] rows i and i + 2; those beyond the end count as nothing. Elimination walks forward and keeps each row's pivot, its two
    factors and its reduced right side; substitution walks back.
    """
    empty = F.expr("cast(array() as array<struct<d:double,l1:double,l2:double,x:double>>)")

    def forward(done: Column, row: Column) -> Column:
        one, two = F.get(done, F.size(done) - 1), F.get(done, F.size(done) - 2)
        pivot = row["d0"] - _or_zero(one["d"] * one["l1"] * one["l1"]) - _or_zero(two["d"] * two["l2"] * two["l2"])
        whole = let(
            pivot,
            lambda d: F.struct(
                d.alias("d"),
                ((row["d1"] - _or_zero(one["d"] * one["l1"] * one["l2"])) / d).alias("l1"),
                (row["d2"] / d).alias("l2"),
                (row["b"] - _or_zero(one["l1"] * one["x"]) - _or_zero(two["l2"] * two["x"])).alias("x"),
            ),
        )
        return F.concat(done, F.array(whole))

    def back(done: Column, row: Column) -> Column:
        after, beyond = F.get(done, F.size(done) - 1), F.get(done, F.size(done) - 2)
        return F.concat(done, F.array(row["x"] / row["d"] - _or_zero(row["l1"] * after) - _or_zero(row["l2"] * beyond)))

    reduced = F.aggregate(rows, empty, forward)
    return F.reverse(F.aggregate(F.reverse(reduced), F.expr("cast(array() as array<double>)"), back))


def iterate(start: Column, step: Callable[[Column], Column], stop: Callable[[Column, Column], Column], limit: int) -> Column:
    """struct(x, done): ``step`` again and again from ``start`` until ``stop`` (before, after) holds, ``limit`` times at most."""

    def once(state: Column, _: Column) -> Column:
        moved = let(step(state["x"]), lambda y: F.struct(y.alias("x"), F.coalesce(stop(state["x"], y), F.lit(True)).alias("done")))
        return F.when(state["done"], state).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.struct(start.cast("double").alias("x"), F.lit(False).alias("done")), once)


def keep_apart(ranked: Column, near: Callable[[Column, Column], Column], most: int | None = None) -> Column:
    """Of an array in rank order, what is ``near`` (kept, item) to none that is kept before it; at most ``most``."""

    def take(kept: Column, x: Column) -> Column:
        free = ~F.exists(kept, lambda k: near(k, x))
        if most is not None:
            free &= F.size(kept) < most
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(ranked, F.slice(ranked, 1, 0), take)
