"""Presets as rows: the filters of a preset (64 at most) travel as one array, and its response on a grid is an array, too. No filter ever becomes rows of a grid.

With s = sin^2(w / 2) at a place, t = s (1 - s), u the same at the filter's frequency, A = 10^(gain / 40) and a = u (1 - u) / q^2, the squared magnitude of
every type is g ((m s - c)^2 + r t) / ((n s - e)^2 + h t): sums of squares, which lose no digits at low frequencies. Spark makes the seven numbers of a filter and
deals presets; a task folds the filters of a block of presets over the grid in numpy. Memory of a task is one block (``BLOCK`` numbers).

On the grid both sums are divided by t: what is squared is then a product of two numbers of a filter and two of a place, and what is added is the filter's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dsp import COEFFICIENT_NAMES
from ..schema import SAMPLE_RATE_HZ

#: Numbers of a block of responses (filters times places).
BLOCK = 1_000_000
#: Numbers of what a fold works on at once: it stays in a core's cache.
PART = 32_768
#: Squared magnitudes below ``TINY`` count as this; up to ``FACTORS`` of them are multiplied before a logarithm is taken, along the grid ``RUN`` of those within ``FAR``.
TINY, FACTORS, RUN, FAR = 1e-300, 8, 24, 1e12
#: Decibels of a doubled squared magnitude.
DB = 10 * math.log10(2)
#: Places between those at which a response is bounded, and what rounding may add to a bound in dB.
STRIDE, SLACK = 64, 1e-6
#: The loss is zero up to a dead band and linear from ``HUBER`` beyond it.
DEADBAND, HUBER = 0.1, 1.0
#: What a fold needs of a filter, and its shape: g, m, c, r over n, e, h.
SHAPE = ["g", "m", "c", "r", "n", "e", "h"]


def shape() -> list[Column]:
    """``SHAPE`` of filters (type, f, gain, q). A high shelf is a low shelf with its two parts exchanged."""
    amp, u = F.pow(F.lit(10.0), F.col("gain") / 40), F.pow(F.sin(F.lit(math.pi) * F.col("f") / SAMPLE_RATE_HZ), 2)
    wide = u * (1 - u) / (F.col("q") * F.col("q"))
    steep, flat = (1 + (amp - 1) * u, amp * u), (amp - (amp - 1) * u, u)
    peak, low = F.col("type") == "PK", F.col("type") == "LS"
    of = lambda k, a, b, c: F.when(peak, a).when(low, b).otherwise(c).alias(k)
    one = F.lit(1.0)
    return [of("g", one, amp * amp, amp * amp), of("m", one, steep[0], flat[0]), of("c", u, steep[1], flat[1]), of("r", wide * amp * amp, amp * wide, amp * wide), of("n", one, flat[0], steep[0]), of("e", u, flat[1], steep[1]), of("h", wide / (amp * amp), amp * wide, amp * wide)]


def packed(filters: DataFrame, *sums: Column, key: str = "preset_id") -> DataFrame:
    """key, filters: an array of (ordinal, enabled, f, gain, shape) of each preset, by ordinal; ``sums`` are further aggregates, which the folds below hand on."""
    parts = filters.withColumn("x", F.struct("ordinal", "enabled", "f", "gain", *shape()))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("filters"), *sums)


def decibels(power: np.ndarray) -> np.ndarray:
    """Levels of squared magnitudes, in their place; the binary logarithm is the cheap one."""
    np.log2(np.maximum(power, TINY, out=power), out=power)
    power *= DB
    return power


def level_sums(power: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of squared magnitudes the sum of the levels in dB, the least and the highest. Where all are within ``FAR``, runs of ``RUN`` are multiplied before a logarithm is taken."""
    lo, hi = power.min(axis=1), power.max(axis=1)
    odd = np.flatnonzero(~((hi < FAR) & (lo > 1 / FAR)))
    with np.errstate(over="ignore", under="ignore"):
        total = decibels(np.multiply.reduceat(power, np.arange(0, power.shape[1], RUN), axis=1)).sum(axis=1)
    total[odd] = decibels(power[odd]).sum(axis=1)
    return total, decibels(lo), decibels(hi)


class Block:
    """Filters of some presets, one after another, and their responses on the grid, made in parts that stay in a core's cache.

    Levels add up, so squared magnitudes multiply: a preset's response takes one logarithm a place, whatever its filters.
    """

    def __init__(self, lists: pa.ListArray, s: np.ndarray):
        items = lists.flatten()
        column = lambda n: items.field(n).to_numpy(zero_copy_only=False)
        self.size = np.diff(lists.offsets.to_numpy())
        self.start = np.cumsum(self.size) - self.size
        self.ordinal, self.on, self.f, self.gain = column("ordinal"), column("enabled").astype(bool), column("f"), column("gain")
        self.shape = np.stack([column(x) for x in SHAPE])
        self.preset = np.repeat(np.arange(len(self.size)), self.size)
        self.s = s
        self.step = max(1, PART // len(s))
        g, m, c, r, n, e, h = self.shape
        root = np.sqrt(g)
        self.above, self.more = np.stack([root * m, -root * c], axis=1), (g * r)[:, None]
        self.below, self.less = np.stack([n, -e], axis=1), h[:, None]
        self.places = np.stack([s, np.ones_like(s)]) / np.sqrt(np.maximum(s * (1 - s), 1e-30))
        self.rooms = np.empty((2, self.step, len(s)))  # one for all parts: memory that is new in every step costs more than the arithmetic

    def on_grid(self, at: np.ndarray) -> np.ndarray:
        """Squared magnitudes of the filters ``at`` (``step`` at most), a row each; the next call takes the same room."""
        above, below = self.rooms[:, : len(at)]
        for out, line, rest in ((above, self.above, self.more), (below, self.below, self.less)):
            np.matmul(line[at], self.places, out=out)
            out *= out
            out += rest[at]
        above /= below
        return above

    def power(self, at: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Squared magnitudes of the filters ``at`` at ``s``: the same places for all, or their own row of it."""
        g, m, c, r, n, e, h = self.shape[:, at, None]
        t = s * (1 - s)
        above, below, more = m * s, n * s, r * t
        above -= c
        above *= above
        above += more
        below -= e
        below *= below
        below += np.multiply(h, t, out=more)
        above /= below
        above *= g
        return above

    def levels(self, at: np.ndarray) -> np.ndarray:
        """Levels in dB of the filters ``at``, a row each."""
        out = np.empty((len(at), len(self.s)))
        for k in range(0, len(at), self.step):
            out[k : k + self.step] = decibels(self.on_grid(at[k : k + self.step]))
        return out

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each filter the sum of its levels, and the largest by magnitude."""
        n = len(self.ordinal)
        total, lo, hi = (np.concatenate(x) for x in zip((np.zeros(0),) * 3, *[level_sums(self.on_grid(np.arange(k, min(n, k + self.step)))) for k in range(0, n, self.step)], strict=True))
        return total, np.maximum(np.abs(lo), np.abs(hi))

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each preset's enabled filters begin in the list of those, and how many it has."""
        count = np.bincount(self.preset[self.on], minlength=len(self.size))
        return np.cumsum(count) - count, count

    def folded(self, presets: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray], places: int) -> np.ndarray:
        """Levels in dB of ``presets``, a row each: the product of ``value`` (filters, their rows) over enabled filters; zeros where none is."""
        enabled = np.flatnonzero(self.on)
        first, count = (x[presets] for x in self.ranked())
        level, most = np.zeros((len(presets), places)), int(count.max(initial=0))
        for k in range(0, most, FACTORS):
            product = np.ones_like(level)
            for i in range(k, min(most, k + FACTORS)):
                rows = np.flatnonzero(count > i)
                part = value(enabled[first[rows] + i], rows)
                if len(rows) == len(presets):
                    product *= part
                else:
                    product[rows] *= part
            np.log10(np.maximum(product, TINY, out=product), out=product)
            product *= 10
            level += product
        return level

    def products(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Parts of the presets: their places, the products of the squared magnitudes of their first ``FACTORS`` enabled filters, and the levels of what is left (none if no preset has more).

        Those with the most filters come first, so that each step works on what lies together. The next part takes the same room.
        """
        enabled = np.flatnonzero(self.on)
        first, count = self.ranked()
        order = np.argsort(-count, kind="stable")
        room = np.empty((self.step, len(self.s)))

        def multiply(some: np.ndarray, out: np.ndarray, k: int) -> None:
            out[:] = 1.0
            for i in range(k, min(int(count[some[0]]), k + FACTORS)):
                n = int(np.searchsorted(-count[some], -i))
                out[:n] *= self.on_grid(enabled[first[some[:n]] + i])

        for at in range(0, len(order), self.step):
            some = order[at : at + self.step]
            power, more = room[: len(some)], None
            if count[some[0]] > FACTORS:
                more = np.zeros_like(power)
                for k in range(FACTORS, int(count[some[0]]), FACTORS):
                    multiply(some, power, k)
                    more += decibels(power)
            multiply(some, power, 0)
            yield some, power, more

    def cascade(self) -> np.ndarray:
        """The sum over the enabled filters of each preset; zeros where none is."""
        out = np.empty((len(self.size), len(self.s)))
        for some, power, more in self.products():
            level = decibels(power)
            out[some] = level if more is None else np.add(level, more, out=level)
        return out

    def losses(self, wish: np.ndarray | None = None, wished: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each preset the mean loss of what its response leaves of its row ``wished`` of ``wish`` (-1, or none given: of a flat wish), and the highest level (0 at least)."""
        fit, boost = np.empty((2, len(self.size)))
        for some, power, more in self.products():
            level = decibels(power)
            if more is not None:
                level += more
            boost[some] = np.maximum(level.max(axis=1), 0.0)
            if wish is not None:
                has = np.flatnonzero(wished[some] >= 0)
                level[has] -= wish[wished[some[has]]]
            np.abs(level, out=level)
            level -= DEADBAND
            np.maximum(level, 0.0, out=level)
            near = np.minimum(level, HUBER, out=self.rooms[0, : len(some)])  # the loss is near (m - near / 2)
            level -= np.multiply(near, 0.5, out=self.rooms[1, : len(some)])
            level *= near
            fit[some] = level.mean(axis=1)
        return fit, boost

    def extent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each preset's response the least level, the highest and the mean; no logarithm of a place is taken where few filters meet."""
        lo, hi, mean = np.empty((3, len(self.size)))
        for some, power, more in self.products():
            if more is None:
                total, lo[some], hi[some] = level_sums(power)
                mean[some] = total / len(self.s)
            else:
                level = np.add(decibels(power), more, out=power)
                lo[some], hi[some], mean[some] = level.min(axis=1), level.max(axis=1), level.mean(axis=1)
        return lo, hi, mean

    def opposing(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of enabled filters of one preset with opposite gains, an octave apart at most, the earlier first."""
        on = np.flatnonzero(self.on & (self.gain != 0))
        most = int(np.bincount(self.preset[on], minlength=1).max())
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for apart in range(1, most):
            i, j = on[:-apart], on[apart:]
            same = self.preset[i] == self.preset[j]
            i, j = i[same], j[same]
            near = (np.sign(self.gain[i]) != np.sign(self.gain[j])) & (np.abs(np.log2(self.f[i] / self.f[j])) <= 1)
            left.append(i[near])
            right.append(j[near])
        a, b = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((b, a))
        return a[order], b[order]

    def scores(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Likeness of the two responses (by magnitude), times nearness, times the smaller gain's share of 15 dB."""
        out = np.zeros(len(left))
        step = max(1, BLOCK // len(self.s))
        for at in range(0, len(left), step):
            a, b = left[at : at + step], right[at : at + step]
            ra, rb = self.levels(a), self.levels(b)
            both, ab = np.einsum("ij,ij->i", ra, ra) * np.einsum("ij,ij->i", rb, rb), np.einsum("ij,ij->i", np.abs(ra, out=ra), np.abs(rb, out=rb))
            out[at : at + step] = np.divide(ab, np.sqrt(both), out=np.zeros(len(a)), where=both > 0) * self.most(a, b)
        return out

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the scores of pairs are if their responses are alike."""
        return (1 - np.abs(np.log2(self.f[a] / self.f[b]))) * np.minimum(np.abs(self.gain[a]), np.abs(self.gain[b])) / 15

    def turns(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each filter the two places among sorted ``s`` before which its response turns (-1: nowhere), and its squared magnitudes there.

        Numerator and denominator are of second order in s, and so is what the derivative's sign depends on: it changes twice at most.
        """
        g, m, c, r, n, e, h = self.shape
        n2, n1, n0, d2, d1, d0 = m * m - r, r - 2 * m * c, c * c, n * n - h, h - 2 * n * e, e * e
        x, y, z = n2 * d1 - n1 * d2, n2 * d0 - n0 * d2, n1 * d0 - n0 * d1
        with np.errstate(all="ignore"):
            w = -(y + np.copysign(np.sqrt(np.maximum(y * y - x * z, 0.0)), y))
            roots = np.stack([w / x, z / w], axis=1)
        roots = np.where((roots > s[0]) & (roots < s[-1]), roots, np.nan)
        there = np.flatnonzero(~np.isnan(roots).all(axis=1))
        at, value = np.full(roots.shape, -1), np.zeros(roots.shape)
        if len(there):
            known = ~np.isnan(roots[there])
            at[there] = np.where(known, np.searchsorted(s, np.where(known, roots[there], s[0])), -1)
            value[there] = np.where(known, self.power(there, np.where(known, roots[there], s[0])), 0.0)
        return at, value

    def peaks(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each preset the highest level on the grid, and its first place, without a look at every place.

        Between two of every ``STRIDE`` places no filter is above its values there and where it turns, so their sum bounds the preset's level; only stretches
        whose bound reaches the best level known are looked at.
        """
        edges = np.r_[np.arange(0, len(self.s) - 1, STRIDE), len(self.s) - 1]
        s = self.s[edges]
        at, value = self.turns(s)
        top, place = np.zeros(len(self.size)), np.zeros(len(self.size), np.int64)
        width = int(np.diff(edges).max()) + 1
        step = max(1, PART // len(edges))
        for k in range(0, len(self.size), step):
            some = np.arange(k, min(len(self.size), k + step))

            def reach(filters: np.ndarray, rows: np.ndarray) -> np.ndarray:
                power = self.power(filters, s)
                most = np.maximum(power[:, :-1], power[:, 1:])
                for turn in (0, 1):
                    for off in (-2, -1, 0):  # the stretch of the turn, and its neighbours, as the turn's place is rounded
                        where = np.clip(at[filters, turn] + off, 0, most.shape[1] - 1)
                        i = np.flatnonzero(at[filters, turn] >= 0)
                        most[i, where[i]] = np.maximum(most[i, where[i]], value[filters[i], turn])
                return most

            known = self.folded(some, lambda filters, _: self.power(filters, s), len(edges)).max(axis=1)
            bound = self.folded(some, reach, len(edges) - 1)
            row, stretch = np.nonzero(~(bound + SLACK < known[:, None]))
            best = np.full(len(some), -np.inf)
            for j in range(0, len(row), max(1, PART // width)):
                part = slice(j, j + max(1, PART // width))
                places = np.minimum(edges[stretch[part]][:, None] + np.arange(width), edges[stretch[part] + 1][:, None])
                level = self.folded(some[row[part]], lambda filters, rows, places=places: self.power(filters, self.s[places[rows]]), width)
                first = np.argmax(level, axis=1)
                for p, x, q in zip(row[part].tolist(), level[np.arange(len(level)), first].tolist(), places[np.arange(len(level)), first].tolist(), strict=True):
                    if x > best[p]:  # stretches rise, so the first of equal places stays
                        best[p], place[k + p] = x, q
            top[some] = best
        return top, place


def _lists(values: np.ndarray) -> pa.Array:
    rows, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), pa.array(values.reshape(-1)))


def _folded(frequencies: list[float], fold: Callable[[Block, pa.RecordBatch], list[pa.Array]], names: list[str]):
    s = np.sin(np.pi * np.array(frequencies) / SAMPLE_RATE_HZ) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, lists = b.column(0), b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            part = np.cumsum(size) // max(1, BLOCK // len(s))
            for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1) if len(size) else []:
                at, n = int(rows[0]), len(rows)
                yield pa.RecordBatch.from_arrays([keys.slice(at, n), *[c.slice(at, n) for c in b.columns[2:]], *fold(Block(lists.slice(at, n), s), b.slice(at, n))], names)

    return run


def _mapped(presets: DataFrame, frequencies: list[float], fold: Callable[[Block, pa.RecordBatch], list[pa.Array]], columns: str) -> DataFrame:
    own = [(c, t) for c, t in presets.dtypes if c != "filters"]
    names = [*[c for c, _ in own], *[x.strip().split(" ")[0] for x in columns.split(";")]]
    return presets.mapInArrow(_folded(frequencies, fold, names), ", ".join([*[f"{c} {t}" for c, t in own], columns.replace(";", ",")]))


def filter_levels(presets: DataFrame, frequencies: list[float]) -> DataFrame:
    """key, ordinal, sum_db, top_db of each filter, enabled or not: the sum and the largest magnitude of its response on the grid."""

    def fold(x: Block, _: pa.RecordBatch) -> list[pa.Array]:
        bounds = pa.array(np.r_[x.start, len(x.ordinal)], pa.int32())
        each = pa.StructArray.from_arrays([pa.array(x.ordinal), *[pa.array(v) for v in x.sums()]], ["ordinal", "sum_db", "top_db"])
        return [pa.ListArray.from_arrays(bounds, each)]

    return _mapped(presets, frequencies, fold, "levels array<struct<ordinal:int,sum_db:double,top_db:double>>").select(presets.columns[0], F.inline("levels"))


def cascades(presets: DataFrame, frequencies: list[float], places: int | None = None) -> DataFrame:
    """key, db: the response of each preset's enabled filters, one number for each frequency, rounded if asked."""

    def fold(x: Block, _: pa.RecordBatch) -> list[pa.Array]:
        level = x.cascade()
        return [_lists(level if places is None else np.round(level, places) + 0.0)]

    return _mapped(presets, frequencies, fold, "db array<double>")


def shapes(presets: DataFrame, frequencies: list[float]) -> DataFrame:
    """key, lo_db, hi_db, mean_db of each preset's response; the response stays in its task."""

    def fold(x: Block, _: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(v) for v in x.extent()]

    return _mapped(presets, frequencies, fold, "lo_db double; hi_db double; mean_db double")


def _pair_lists(x: Block, least: float) -> pa.Array:
    left, right = x.opposing()
    likely = x.most(left, right) >= least - 1e-9  # likeness is 1 at most
    left, right = left[likely], right[likely]
    score = x.scores(left, right)
    kept = score >= least
    left, right, score = left[kept], right[kept], score[kept]
    bounds = np.searchsorted(left, np.r_[x.start, len(x.f)])  # left places rise
    each = pa.StructArray.from_arrays([pa.array(x.ordinal[left]), pa.array(x.ordinal[right]), pa.array(score)], ["a", "b", "score"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each)


def audited(presets: DataFrame, frequencies: list[float], least: float = 0.35, wanted: str | None = None) -> DataFrame:
    """key, fit, boost_db, enabled, pairs: the mean loss of what the preset's response leaves of the wish, the most that it lifts any place (0 at least), its enabled
    filters, and its opposing pairs (a, b, score) from ``least`` on.

    ``wanted`` names a column of ``presets`` with the wish as an array (one number for each frequency); without it, or where it is null, the wish is flat.
    """
    at = presets.columns.index(wanted) if wanted else None

    def fold(x: Block, rows: pa.RecordBatch) -> list[pa.Array]:
        wish = wished = None
        if at is not None:
            has = rows.column(at).is_valid().to_numpy(zero_copy_only=False)
            wish = rows.column(at).flatten().to_numpy(zero_copy_only=False).reshape(int(has.sum()), len(frequencies))
            wished = np.where(has, np.cumsum(has) - 1, -1)
        fit, boost = x.losses(wish, wished)
        return [pa.array(fit), pa.array(boost), pa.array(np.add.reduceat(x.on.astype(np.int64), x.start)), _pair_lists(x, least)]

    return _mapped(presets, frequencies, fold, "fit double; boost_db double; enabled long; pairs array<struct<a:int,b:int,score:double>>")


def cancellations(presets: DataFrame, frequencies: list[float], least: float = 0.35) -> DataFrame:
    """key, a, b, score, severity of opposing filters within an octave."""
    found = _mapped(presets, frequencies, lambda x, _: [_pair_lists(x, least)], "pairs array<struct<a:int,b:int,score:double>>")
    return found.select(presets.columns[0], F.inline("pairs")).withColumn("severity", F.when(F.col("score") >= 0.65, "strong").otherwise("moderate"))


def opposed(presets: DataFrame, frequencies: list[float], least: float = 0.35) -> DataFrame:
    """key, enabled, pairs as ``audited`` gives them, without the response of the whole preset: only filters that may oppose each other are looked at."""

    def fold(x: Block, _: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.add.reduceat(x.on.astype(np.int64), x.start)), _pair_lists(x, least)]

    return _mapped(presets, frequencies, fold, "enabled long; pairs array<struct<a:int,b:int,score:double>>")


def severities(audit: DataFrame, *keep: str) -> DataFrame:
    """key, ``keep``, enabled, moderate, strong, total_score of ``audited`` or ``opposed`` presets."""
    strong = F.size(F.filter("pairs", lambda p: p["score"] >= 0.65))
    total = F.aggregate("pairs", F.lit(0.0), lambda t, p: t + p["score"])
    return audit.select(audit.columns[0], *keep, "enabled", (F.size("pairs") - strong).cast("long").alias("moderate"), strong.cast("long").alias("strong"), total.alias("total_score"))


def binned(presets: DataFrame, frequencies: list[float], weights: list[list[tuple[int, float]]], places: int | None = None) -> DataFrame:
    """key, gain: weighted sums of the response in bins (each a list of places and weights), with the largest at 0 dB, rounded if asked."""

    def fold(x: Block, _: pa.RecordBatch) -> list[pa.Array]:
        gain = _bins(x, weights)
        return [_lists(gain if places is None else np.round(gain, places) + 0.0)]

    return _mapped(presets, frequencies, fold, "gain array<double>")


def _bins(x: Block, weights: list[list[tuple[int, float]]]) -> np.ndarray:
    at, share = (np.array([p[i] for parts in weights for p in parts]) for i in (0, 1))
    level = np.add.reduceat(x.cascade()[:, at] * share, np.cumsum([0, *[len(parts) for parts in weights]])[:-1], axis=1)
    return level - level.max(axis=1, keepdims=True)


class _Items(dict):
    """Texts of a place and a gain in tenths, made when they are first asked for."""

    def __init__(self, name: str):
        self.name = name

    def __missing__(self, tenths: int) -> str:
        self[tenths] = text = f"{self.name} -{tenths // 10}.{tenths % 10}"
        return text


def _tenths(a: np.ndarray) -> np.ndarray:
    """Tenths of numbers of 0 or more, halves of the exact binary value up: what rounding left of the product (Dekker) decides, as in ``functions.text.fixed``."""
    p = a * 10.0
    low = np.floor(p)
    big = a * 134217729.0
    hi = big - (big - a)
    error = (a - hi) * 10.0 - (p - hi * 10.0)
    return (low + ((p - (low + 0.5)) + error >= 0)).astype(np.int64)


def binned_texts(presets: DataFrame, frequencies: list[float], centres: list[float], weights: list[list[tuple[int, float]]]) -> DataFrame:
    """key, items: ``binned`` as texts of a frequency and a gain with one digit, an array for each preset."""
    names = [str(int(x)) for x in centres]

    def fold(x: Block, _: pa.RecordBatch) -> list[pa.Array]:
        gain = _bins(x, weights)
        kept = [_Items(n) for n in names]
        top = [f"{n} 0.0" for n in names]
        rows = zip(_tenths(np.abs(gain)).tolist(), (gain < 0).tolist(), strict=True)  # the largest is 0, so no gain is above
        return [pa.array([[kept[i][k] if below else top[i] for i, (k, below) in enumerate(zip(tenths, signs, strict=True))] for tenths, signs in rows], pa.list_(pa.string()))]

    return _mapped(presets, frequencies, fold, "items array<string>")


def peaks(presets: DataFrame, frequencies: list[float]) -> DataFrame:
    """key, top_db, top_hz of each preset's response: the most that it lifts any place and where first; 0 and the first place if it lifts none."""
    grid = np.array(frequencies)

    def fold(x: Block, _: pa.RecordBatch) -> list[pa.Array]:
        top, place = x.peaks()
        lifts = top > 1e-9  # what is less is rounding
        return [pa.array(np.where(lifts, top, 0.0)), pa.array(np.where(lifts, grid[place], grid[0]))]

    return _mapped(presets, frequencies, fold, "top_db double; top_hz double")


def expanded_levels(filters: DataFrame, frequencies: list[float]) -> DataFrame:
    """preset_id, ordinal, sum_db, top_db as ``filter_levels`` gives them, of filters with their coefficients (``dsp.with_coefficients``), by the expanded form of the response."""
    w = 2 * np.pi * np.array(frequencies) / SAMPLE_RATE_HZ
    cw, c2 = np.cos(w), np.cos(2 * w)

    def power(b0, b1, b2, a1, a2) -> np.ndarray:
        num = b0 * b0 + b1 * b1 + b2 * b2 + 2 * (b0 * b1 + b1 * b2) * cw + 2 * b0 * b2 * c2
        return num / (1 + a1 * a1 + a2 * a2 + 2 * (a1 + a1 * a2) * cw + 2 * a2 * c2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PART // len(w))
        for b in batches:
            c = np.stack([x.to_numpy(zero_copy_only=False) for x in b.columns[2:]])[:, :, None]
            out = [level_sums(power(*c[:, k : k + step])) for k in range(0, b.num_rows, step)]
            if out:
                total, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.array(np.maximum(np.abs(lo), np.abs(hi)))], ["preset_id", "ordinal", "sum_db", "top_db"])

    return filters.select("preset_id", "ordinal", *COEFFICIENT_NAMES).mapInArrow(run, "preset_id long, ordinal int, sum_db double, top_db double")
