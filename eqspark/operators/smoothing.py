"""Smoothing spline over the logarithm of frequency, with a strength that falls along the curve, as column expressions.

Minimizing the weighted squared change plus the bending energy gives y - D^2 G' c with (R + G D^2 G') c = G y, where G takes second
divided differences and R is the tridiagonal matrix of hat-function products: a symmetric system with two bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import solve_two_bands

SCALE, DECLINE = 0.01, 80.0
#: Numbers of the series that ``series`` gives at once.
SERIES = 500_000


def smoothed(points: DataFrame, level: float, key: str = "curve_id") -> DataFrame:
    """key, f, db of the smoothing spline; unchanged at level 0 and for curves of fewer than three points.

    A curve is one row from its grouping on; the folds copy what they have, so their work grows with the square of a curve's points (some hundreds).
    """
    rows = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "db"))).alias("p"))
    rows = rows.select(key, F.transform("p", lambda x: x["f"]).alias("f"), F.transform("p", lambda x: x["db"]).alias("y"))
    at = lambda a, i: F.get(a, i)
    n = F.size("y")
    if level == 0:
        out = rows.withColumn("z", F.col("y"))
    else:
        upto = lambda k: F.sequence(F.lit(0), n - k)  # noqa: E731  (of curves with three points or more)
        rows = rows.withColumn("h", F.when(n >= 3, F.transform(upto(2), lambda i: F.log(at(F.col("f"), i + 1)) - F.log(at(F.col("f"), i)))))
        share = lambda i: F.pow(i / n, 2)
        rows = rows.withColumn("w", F.transform("y", lambda _, i: F.pow(F.lit(level * SCALE) * F.pow(F.lit(1 / DECLINE), share(i)), 2)))
        second = lambda i: F.struct((1 / at(F.col("h"), i)).alias("a"), (-(1 / at(F.col("h"), i) + 1 / at(F.col("h"), i + 1))).alias("b"), (1 / at(F.col("h"), i + 1)).alias("c"))
        rows = rows.withColumn("g", F.when(n >= 3, F.transform(upto(3), second)))
        rows = rows.withColumn("c", F.when(n >= 3, solve_two_bands(F.transform("g", _row))))
        rows = rows.withColumn("z", F.when(n >= 3, F.transform("y", lambda y, i: y - at(F.col("w"), i) * _bend(i))).otherwise(F.col("y")))
        out = rows
    return out.select(key, F.inline(F.arrays_zip(F.col("f").alias("f"), F.col("z").alias("db"))))


def _row(g: Column, i: Column) -> Column:
    """Diagonals and right side of the system at ``i``."""
    at = lambda name, k: F.get(F.col(name), k)
    h, w, y = (lambda k, name=name: at(name, i + k) for name in ("h", "w", "y"))
    one, two = at("g", i + 1), at("g", i + 2)
    zero = F.lit(0.0)
    d0 = (h(0) + h(1)) / 3 + (g["a"] * g["a"] * w(0) + g["b"] * g["b"] * w(1) + g["c"] * g["c"] * w(2))
    d1 = F.when(one.isNotNull(), h(1) / 6 + g["b"] * one["a"] * w(1) + g["c"] * one["b"] * w(2)).otherwise(zero)
    d2 = F.when(two.isNotNull(), g["c"] * two["a"] * w(2)).otherwise(zero)
    return F.struct(d0.alias("d0"), d1.alias("d1"), d2.alias("d2"), (g["a"] * y(0) + g["b"] * y(1) + g["c"] * y(2)).alias("b"))


def _bend(i: Column) -> Column:
    part = lambda k, name: F.when(i >= k, F.coalesce(F.get(F.col("g"), i - k)[name] * F.get(F.col("c"), i - k), F.lit(0.0))).otherwise(F.lit(0.0))
    return part(0, "a") + part(1, "b") + part(2, "c")


def spline(f: np.ndarray, y: np.ndarray, level: float) -> np.ndarray:
    """The smoothing spline of curves ``y``, a row each, that share three or more rising frequencies: the system depends on these alone and is factored once."""
    n = len(f)
    h, w = np.diff(np.log(f)), (level * SCALE * (1 / DECLINE) ** ((np.arange(n) / n) ** 2)) ** 2
    a, c = 1 / h[:-1], 1 / h[1:]
    b = -(a + c)
    zero = np.zeros(2)
    d0 = (h[:-1] + h[1:]) / 3 + a * a * w[:-2] + b * b * w[1:-1] + c * c * w[2:]
    d1 = np.r_[h[1:-1] / 6 + b[:-1] * a[1:] * w[1:-2] + c[:-1] * b[1:] * w[2:-1], zero[:1]]
    d2 = np.r_[c[:-2] * a[2:] * w[2:-2], zero][: n - 2]
    m = n - 2
    d, one, two = [0.0] * m, [0.0] * m, [0.0] * m
    u = (a * y[:, :-2] + b * y[:, 1:-1] + c * y[:, 2:]).T.copy()
    for i, (p, q, r) in enumerate(zip(d0.tolist(), d1.tolist(), d2.tolist(), strict=True)):
        if i > 0:
            p, q = p - d[i - 1] * one[i - 1] ** 2, q - d[i - 1] * one[i - 1] * two[i - 1]
            u[i] -= one[i - 1] * u[i - 1]
        if i > 1:
            p -= d[i - 2] * two[i - 2] ** 2
            u[i] -= two[i - 2] * u[i - 2]
        d[i], one[i], two[i] = p, q / p, r / p
    for i in range(m - 1, -1, -1):
        u[i] /= d[i]
        if i + 1 < m:
            u[i] -= one[i] * u[i + 1]
        if i + 2 < m:
            u[i] -= two[i] * u[i + 2]
    bend = np.zeros_like(y)
    bend[:, :-2] += a * u.T
    bend[:, 1:-1] += b * u.T
    bend[:, 2:] += c * u.T
    return y - w * bend


def _display_places(f: np.ndarray, points_per_octave: int = 48) -> np.ndarray:
    """A curve's own ends and the places of the display grid between them (``grids.display_grid``)."""
    from ..schema import MIN_HZ

    lo, hi = float(f[0]), float(f[-1])
    k = np.arange(np.floor(np.log2(lo / MIN_HZ) * points_per_octave), np.ceil(np.log2(hi / MIN_HZ) * points_per_octave) + 1)
    at = MIN_HZ * 2.0 ** (k / points_per_octave)
    return np.r_[lo, at[(at > lo) & (at < hi)], hi] if hi > lo else np.array([lo])


def _drawn(f: np.ndarray, y: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and levels of curves, a row each, on the rising frequencies ``f``: on the display grid where that has three places, and smoothed."""
    if level <= 0:
        return f, y
    at = _display_places(f)
    if len(at) >= 3:
        i = np.clip(np.searchsorted(f, at, side="right") - 1, 0, len(f) - 2)
        left, right, a, b = f[i], f[i + 1], y[:, i], y[:, i + 1]
        value = a + np.log(at / left) / np.log(right / left) * (b - a)
        value[:, at == left], value[:, at == right] = a[:, at == left], b[:, at == right]
        f, y = at, value
    return f, spline(f, y, level) if len(f) >= 3 else y


def series(curves: DataFrame, level: float, key: str = "curve_id") -> DataFrame:
    """key, f, db of curves (key, f, db: arrays in the points' order) as a graph draws them: valid points, the last of equal frequencies, on the display grid, smoothed.

    A curve stays in its row; those of equal frequencies are smoothed together, so memory of a task is a block of series.
    """
    kind = dict(curves.dtypes)[key].replace("bigint", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[bytes, list[tuple[int, np.ndarray]]] = {}
            for i, (f, y) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                if f.values is None or y.values is None:
                    continue
                f, y = (x.values.to_numpy(zero_copy_only=False).astype(np.float64) for x in (f, y))
                fine = np.flatnonzero((f > 0) & np.isfinite(f) & np.isfinite(y))
                f, at = np.unique(f[fine[::-1]], return_index=True)  # the last of equals comes first in reverse
                if len(f):
                    groups.setdefault(f.tobytes(), []).append((i, y[fine[::-1]][at]))
            for own, rows in groups.items():
                f = np.frombuffer(own)
                step = max(1, SERIES // max(len(f), len(_display_places(f))))
                for k in range(0, len(rows), step):
                    at, db = _drawn(f, np.stack([y for _, y in rows[k : k + step]]), level)
                    keys = b.column(0).take(pa.array(np.repeat([i for i, _ in rows[k : k + step]], len(at))))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(at, len(db))), pa.array(db.reshape(-1))], [key, "f", "db"])

    return curves.select(key, "f", "db").mapInArrow(run, f"{key} {kind}, f double, db double")
