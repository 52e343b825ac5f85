"""Plain numpy forms that column expressions are held to."""

from __future__ import annotations

import math

import numpy as np

from eqspark.operators.fitting.loudness import parameters
from eqspark.schema import EqError


def _solve_two_bands(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric positive system with diagonals d0, d1 (first) and d2 (second)."""
    n = len(d0)
    d, l1, l2 = np.zeros(n), np.zeros(n), np.zeros(n)  # l1[i]: row i+1, l2[i]: row i+2
    x = b.astype(np.float64).copy()
    for i in range(n):
        d[i] = d0[i] - (d[i - 1] * l1[i - 1] ** 2 if i else 0) - (d[i - 2] * l2[i - 2] ** 2 if i > 1 else 0)
        if i + 1 < n:
            l1[i] = (d1[i] - (d[i - 1] * l1[i - 1] * l2[i - 1] if i else 0)) / d[i]
        if i + 2 < n:
            l2[i] = d2[i] / d[i]
        x[i] -= (l1[i - 1] * x[i - 1] if i else 0) + (l2[i - 2] * x[i - 2] if i > 1 else 0)
    x /= d
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i] * x[i + 1] + (l2[i] * x[i + 2] if i + 2 < n else 0)
    return x


def smooth(f: np.ndarray, db: np.ndarray, level: float, scale: float = 0.01) -> np.ndarray:
    """Smoothed levels; unchanged at level 0 or below three points."""
    y = np.asarray(db, np.float64)
    if level == 0 or len(y) < 3:
        return y.copy()
    h = np.diff(np.log(np.asarray(f, np.float64)))
    n = len(y)
    weight = (level * scale * (1 / 80) ** ((np.arange(n) / n) ** 2)) ** 2
    g = np.stack([1 / h[:-1], -(1 / h[:-1] + 1 / h[1:]), 1 / h[1:]])  # rows of G at columns i, i+1, i+2
    w = np.stack([weight[:-2], weight[1:-1], weight[2:]])
    d0 = (h[:-1] + h[1:]) / 3 + (g * g * w).sum(axis=0)
    d1 = np.zeros(n - 2)
    d1[:-1] = h[1:-1] / 6 + (g[1, :-1] * g[0, 1:] * w[1, :-1]) + (g[2, :-1] * g[1, 1:] * w[2, :-1])
    d2 = np.zeros(n - 2)
    d2[:-2] = g[2, :-2] * g[0, 2:] * w[2, :-2]
    c = _solve_two_bands(d0, d1, d2, g[0] * y[:-2] + g[1] * y[1:-1] + g[2] * y[2:])
    bend = np.zeros(n)
    for k in range(3):
        bend[k : n - 2 + k] += g[k] * c
    return y - weight * bend


def loudness_offset(f: np.ndarray, db: np.ndarray, level: float, free_field: np.ndarray, limit: int = 500) -> float:
    """Newton's method on the loudness sum; a step of at most 0.01 dB ends it."""
    f, db = np.asarray(f, np.float64), np.asarray(db, np.float64)
    if len(f) < 2 or not (np.isfinite(f).all() and np.isfinite(db).all() and (np.diff(f) > 0).all() and f[0] > 0 and math.isfinite(level)):
        raise EqError("validation", "loudness needs two or more finite points at rising positive frequencies")
    alpha, offset, factor, field = parameters(f, free_field)
    per_db, x = math.log(10) / 10, 0.0
    for _ in range(limit):
        power = np.exp(per_db * (db + x - field))
        inner = offset + power**alpha
        total = float((factor * inner**4).sum())
        slope = float((factor * 4 * inner**3 * alpha * power ** (alpha - 1) * per_db * power).sum())
        if not (math.isfinite(total) and math.isfinite(slope)) or total <= 0 or slope == 0:
            raise EqError("numeric", "the loudness sum cannot be inverted")
        step = (math.log(total) - level * per_db) * total / slope
        x -= step
        if abs(step) <= 0.01:
            return x
    raise EqError("numeric", "the loudness offset did not converge")
