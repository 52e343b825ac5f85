"""Pairs of curves as rows: a source and its target travel as arrays of points, and what is asked of the wanted correction (target less source, both normalized) is made in
the task that has the row. No curve ever becomes rows of a grid: no sort, window or join of places, and memory of a task is one block (``BLOCK`` numbers).

A place that a curve does not cover is not there; one between levels that are null is there without a level, as in the row forms (``curves``, ``metrics``, ``features``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import MAX_GAIN_DB, MAX_HZ, MAX_Q, MIN_HZ, MIN_Q, SHELF_Q

#: Numbers of a block (pairs times places).
BLOCK = 500_000
ERRORS = ["mae", "rmse", "max_abs", "max_abs_hz"]
SHELVES = (("LS", 20.0, 200.0, 105.0), ("HS", 8000.0, 20_000.0, 10_000.0))


def _alike(size: np.ndarray, f: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of equal frequencies together."""
    n, m = len(size), int(size[0]) if len(size) else 0
    if n and (size == m).all() and (f.reshape(n, m) == f[:m]).all():
        yield np.arange(n)
        return
    groups: dict[bytes, list[int]] = {}
    for i, part in enumerate(np.split(f, np.cumsum(size)[:-1])):
        groups.setdefault(part.tobytes(), []).append(i)
    yield from (np.array(rows) for rows in groups.values())


def placed(f: pa.ListArray, db: pa.ListArray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of curves at rising ``places``, a row each, which places are there, and which have a level; between points by the logarithm of frequency."""
    size = np.diff(f.offsets.to_numpy())
    start = np.cumsum(size) - size
    hz, given = f.flatten().to_numpy(zero_copy_only=False).astype(np.float64), db.flatten()
    y, ok = given.to_numpy(zero_copy_only=False).astype(np.float64), given.is_valid().to_numpy(zero_copy_only=False)
    level, there = np.zeros((len(size), len(places))), np.zeros((len(size), len(places)), bool)
    known = there.copy()
    for rows in _alike(size, hz):
        own = hz[start[rows[0]] : start[rows[0]] + size[rows[0]]]
        order = np.flatnonzero(np.isfinite(own))
        order = order[np.argsort(own[order], kind="stable")]
        own = own[order]
        if len(own) < 2:
            continue
        i = np.searchsorted(own, places, side="right") - 1
        i[(i == len(own) - 1) & (places == own[-1])] -= 1  # the last segment has its right end, too
        at = np.flatnonzero((i >= 0) & (i < len(own) - 1))
        i, x = i[at], places[at]
        left, right = own[i], own[i + 1]
        mine = start[rows][:, None] + order
        points, fine = y[mine], ok[mine]
        a, b, has_a, has_b = points[:, i], points[:, i + 1], fine[:, i], fine[:, i + 1]
        on_left, on_right = x == left, (x == right) & (x != left)
        with np.errstate(all="ignore"):
            value = a + np.log(x / left) / np.log(right / left) * (b - a)
        value[:, on_left], value[:, on_right] = a[:, on_left], b[:, on_right]
        has = np.where(on_left, has_a, np.where(on_right, has_b, has_a & has_b))
        cells = np.ix_(rows, at)
        there[cells], known[cells], level[cells] = True, has, np.where(has, value, 0.0)
    return level, there, known


def normalized(f: pa.ListArray, db: pa.ListArray, grid: np.ndarray, anchor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``placed`` on the grid, with 0 dB at the anchor; nothing is there of a curve without a level at the anchor."""
    level, there, known = placed(f, db, np.r_[grid, anchor])
    with np.errstate(invalid="ignore"):
        level -= level[:, -1:]
    there, known = there & known[:, -1:], known & known[:, -1:]
    return np.where(known, level, 0.0)[:, :-1], there[:, :-1], known[:, :-1]


class Block:
    """Wanted corrections of some pairs: levels on the grid (0 where there is none), a row each, which places are ``there``, and which are ``known``."""

    def __init__(self, f: np.ndarray, level: np.ndarray, there: np.ndarray, known: np.ndarray):
        self.f, self.level, self.there, self.known = f, level, there, known

    @classmethod
    def of(cls, rows: pa.RecordBatch, grid: np.ndarray, anchor: float) -> Block:
        """Of rows (target_id, f, db, target_f, target_db); a target that several have is placed once."""
        column = lambda n: rows.column(rows.schema.get_field_index(n))
        source = normalized(column("f"), column("db"), grid, anchor)
        _, first, which = np.unique(column("target_id").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        target = [x[which] for x in normalized(column("target_f").take(pa.array(first)), column("target_db").take(pa.array(first)), grid, anchor)]
        known = source[2] & target[2]
        with np.errstate(invalid="ignore"):
            return cls(grid, np.where(known, target[0] - source[0], 0.0), source[1] & target[1], known)

    def compared(self) -> np.ndarray:
        """Levels for comparisons, in which a level that is no number is above all others."""
        return np.where(np.isnan(self.level), np.inf, self.level)

    def errors(self, lo: float = 0.0, hi: float = np.inf) -> tuple[np.ndarray, list[pa.Array]]:
        """Rows with places from ``lo`` to ``hi``, both included, and their ``ERRORS``; of equal deviations the first counts."""
        at = np.flatnonzero((self.f >= lo) & (self.f <= hi))
        rows = np.flatnonzero(self.there[:, at].any(axis=1))
        size, known, there = np.abs(self.level[np.ix_(rows, at)]), self.known[np.ix_(rows, at)], self.there[np.ix_(rows, at)]
        count = known.sum(axis=1)
        top = np.argmax(np.where(known, size, np.where(there, -1.0, -2.0)), axis=1)  # without any level, the first place that is there
        none = count == 0
        count = np.maximum(count, 1)
        square = np.einsum("ij,ij->i", size, size)
        values = size.sum(axis=1) / count, np.sqrt(square / count), size[np.arange(len(rows)), top]
        return rows, [*[pa.array(v, mask=none) for v in values], pa.array(self.f[at[top]])]

    def runs(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last place, and sign of maximal runs of one sign at or above the threshold."""
        x = self.compared()
        sign = np.where(self.known & (np.abs(x) >= threshold), np.where(x < 0, -1, 1), 0)
        edge = np.zeros((len(sign), 1), sign.dtype)
        change = np.diff(np.concatenate([edge, sign, edge], axis=1), axis=1) != 0
        row, at = np.nonzero(change)  # places where a run of any sign begins, and the place after the last one
        inside = at < len(self.f)
        begin = np.flatnonzero(inside)
        begin = begin[sign[row[begin], at[begin]] != 0]
        return row[begin], at[begin], at[begin + 1] - 1, sign[row[begin], at[begin]]

    def extrema(self, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of local extremes inside the curve, at or above the floor."""
        x = self.compared()
        mid, before, after = x[:, 1:-1], x[:, :-2], x[:, 2:]
        found = ((mid > 0) & (mid >= before) & (mid > after)) | ((mid < 0) & (mid <= before) & (mid < after))
        found &= (np.abs(mid) >= floor) & self.known[:, 1:-1] & self.known[:, :-2] & self.known[:, 2:]
        row, at = np.nonzero(found)
        return row, at + 1

    def boundaries(self, floor: float) -> list[np.ndarray]:
        """Row, place, left and right boundary, left and right half height of each extreme (``features.boundaries``)."""
        rows, tops = self.extrema(floor)
        x = self.compared()
        size, out = np.abs(x), np.empty((4, len(rows)), np.int64)
        bounds = np.searchsorted(rows, np.arange(len(x) + 1))
        for r in np.unique(rows).tolist():
            known = np.flatnonzero(self.known[r])
            edges = np.flatnonzero(self.there[r])[[0, -1]].tolist()
            v, s = size[r, known], np.sign(x[r, known])
            cut = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)]
            for k in range(int(bounds[r]), int(bounds[r + 1])):
                at = int(np.searchsorted(known, tops[k]))
                run = int(np.searchsorted(cut, at, side="right")) - 1
                a, b, half = int(cut[run]), int(cut[run + 1]), v[at] / 2
                low, high = np.flatnonzero(v[a:at] <= half), np.flatnonzero(v[at + 1 : b] <= half)
                near = [int(known[a + low[-1]]) if len(low) else None, int(known[at + 1 + high[0]]) if len(high) else None]
                cross = [int(known[a - 1]) if a else None, int(known[b]) if b < len(s) else None]
                side = [next(c for c in (cross[i], near[i], edges[i]) if c is not None) for i in (0, 1)]
                out[:, k] = *side, *(side[i] if near[i] is None else near[i] for i in (0, 1))
        return [rows, tops, *out]

    def shelves(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, number in ``SHELVES``, gain and octaves of ends that speak for a shelf: 70 % of one sign and a median size of the threshold at least."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for kind, (_, lo, hi, _) in enumerate(SHELVES):
            at = np.flatnonzero((self.f >= lo) & (self.f <= hi))
            there, known, x = self.there[:, at], self.known[:, at], self.compared()[:, at]
            with np.errstate(all="ignore"):
                most = np.maximum((known & (x > 0)).sum(axis=1), (known & (x < 0)).sum(axis=1)) / there.sum(axis=1)
            rows = np.flatnonzero(most >= 0.7)
            whole = known[rows].all(axis=1)
            gain, size = np.empty(len(rows)), np.empty(len(rows))
            part = x[rows[whole]]
            gain[whole], size[whole] = np.median(part, axis=1), np.median(np.abs(part), axis=1)
            for k in np.flatnonzero(~whole).tolist():
                own = x[rows[k], known[rows[k]]]
                gain[k], size[k] = np.median(own), np.median(np.abs(own))
            first, last = there[rows].argmax(axis=1), len(at) - 1 - there[rows][:, ::-1].argmax(axis=1)
            octaves, fine = np.log2(self.f[at[last]] / self.f[at[first]]), size >= threshold
            found.append((rows[fine], np.full(int(fine.sum()), kind), np.clip(gain[fine], -MAX_GAIN_DB, MAX_GAIN_DB), octaves[fine]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def candidates(self, threshold: float) -> tuple[np.ndarray, list[pa.Array]]:
        """Row, and type, f, gain, q, octaves of first-generation candidates (``features.candidates`` before they are ranked)."""
        row, a, b, _ = self.runs(threshold)
        lo, hi = self.f[a], self.f[b]
        centre = np.clip(np.sqrt(lo * hi), MIN_HZ, MAX_HZ)
        i = np.clip(np.searchsorted(self.f, centre, side="right") - 1, 0, len(self.f) - 2)
        left, right, before, after = self.f[i], self.f[i + 1], self.level[row, i], self.level[row, i + 1]
        with np.errstate(invalid="ignore"):
            level = np.where(centre == left, before, np.where(centre == right, after, before + np.log(centre / left) / np.log(right / left) * (after - before)))
        level = np.where(np.isnan(level), MAX_GAIN_DB, np.clip(level, -MAX_GAIN_DB, MAX_GAIN_DB))
        q = np.clip(centre / np.maximum(hi - lo, 1e-9), MIN_Q, MAX_Q)
        at, kind, gain, octaves = self.shelves(threshold)
        rows = np.r_[row, at]
        order = np.argsort(rows, kind="stable")
        types = np.r_[np.full(len(row), "PK"), np.array([t for t, *_ in SHELVES])[kind]]
        nominal = np.array([f for *_, f in SHELVES])[kind]
        values = np.r_[centre, nominal], np.r_[level, gain], np.r_[q, np.full(len(at), SHELF_Q)], np.r_[np.log2(hi / lo), octaves]
        return rows[order], [pa.array(types[order].tolist(), pa.string()), *[pa.array(v[order]) for v in values]]


def folded(pairs: DataFrame, grid: list[float], anchor: float, fold: Callable[[Block], Iterator[tuple[np.ndarray, list[pa.Array]]]], columns: str, key: str = "pair_id") -> DataFrame:
    """key, ``columns`` of ``pairs`` (key, target_id, f, db, target_f, target_db): ``fold`` gives rows of a block, as places of its pairs and values for each."""
    names = [key, *[x.strip().split(" ")[0] for x in columns.split(";")]]
    kind = dict(pairs.dtypes)[key].replace("bigint", "long")
    places = np.array(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // len(places))
        for b in batches:
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                keys = part.column(part.schema.get_field_index(key))
                for rows, values in fold(Block.of(part, places, anchor)):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *values], names)

    return pairs.select(key, "target_id", "f", "db", "target_f", "target_db").mapInArrow(run, f"{key} {kind}, {columns.replace(';', ',')}")


def error_metrics(pairs: DataFrame, grid: list[float], anchor: float) -> DataFrame:
    """pair_id and ``ERRORS`` of each pair's wanted correction."""
    return folded(pairs, grid, anchor, lambda x: iter([x.errors()]), "; ".join(f"{c} double" for c in ERRORS))


def band_metrics(pairs: DataFrame, grid: list[float], anchor: float, bands: list[tuple[str, float, float]]) -> DataFrame:
    """pair_id, band and the ``ERRORS`` of each band, both ends included."""

    def fold(x: Block) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        for name, lo, hi in bands:
            rows, values = x.errors(lo, hi)
            yield rows, [pa.array([name] * len(rows), pa.string()), *values]

    return folded(pairs, grid, anchor, fold, "band string; " + "; ".join(f"{c} double" for c in ERRORS))


def boundaries(pairs: DataFrame, grid: list[float], anchor: float, floor: float = 0.15) -> DataFrame:
    """pair_id, idx, left_idx, right_idx, half_left_idx, half_right_idx of each extreme of the wanted correction."""

    def fold(x: Block) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        rows, *found = x.boundaries(floor)
        yield rows, [pa.array(v.astype(np.int32)) for v in found]

    return folded(pairs, grid, anchor, fold, "; ".join(f"{c} int" for c in ("idx", "left_idx", "right_idx", "half_left_idx", "half_right_idx")))


def candidates(pairs: DataFrame, grid: list[float], anchor: float, threshold: float = 0.5, tolerance: float = 1 / 48) -> DataFrame:
    """pair_id, place (from 1), type, f, gain, q, octaves: first-generation candidates of the wanted correction, ranked and without near-repeats (``features.candidates``)."""
    from .features import kept_candidates

    def fold(x: Block) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        rows, values = x.candidates(threshold)
        pair, first = np.unique(rows, return_index=True)
        each = pa.StructArray.from_arrays(values, ["type", "f", "gain", "q", "octaves"])
        yield pair, [pa.ListArray.from_arrays(pa.array(np.r_[first, len(rows)], pa.int32()), each)]

    found = folded(pairs, grid, anchor, fold, "items array<struct<type:string,f:double,gain:double,q:double,octaves:double>>")
    return kept_candidates(found, "pair_id", tolerance)
