"""Substring dedup by level-wise doubling: windows of words that repeat at one length alone are extended to twice that length.

A window is ``window`` consecutive words of one document. Each word that is covered by a window whose word sequence also starts earlier (in a document
that comes first, or earlier in the same one) is removed; windows are judged on the input.

Levels double from ``first`` words up to ``window`` (5, 10, 20); the last is the length asked for, and longer repeats consist of repeats of that length. A level
hashes its windows, finds the hashes that occur more than once in the corpus, and only stretches of text around these go on, as word hashes, to the
next level; where none is left, the search ends. Below the last level not all windows are sent: in every run of windows that lie within one window of the
full length, the one with the least hash is (with ties, all of them). The choice depends on the words alone, so both occurrences of a repeat send the same hash, no
repeat is lost, and some eighth of the windows is shuffled. At the last level every window left is compared by 128 bits of hash. A document sends each
hash once; what repeats within it is settled there.

Documents come in the order of doc_id; null ids come after all others, rows that share an id by a hash of their words. Documents equal word for word meet in
a count: the first of them takes part for all, and the others, whose windows all start earlier there, keep nothing (if they have ``window`` words).

Hot windows: hashes are counted with partial aggregates and met again by a join of both shuffled sides, which AQE splits. Starts of removed windows are gathered by document, so memory is bounded by
a document.

Edge cases: null and empty texts, and those shorter than a window, lose nothing (the hash of no words is that of ''); of rows equal in id and words one takes part and the others count as later; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

WINDOW = 20
#: Words of the first level's windows.
FIRST = 5
#: Bytes of text whose words are hashed together; rows of a batch that is given on.
CHUNK = 2_000_000
ROWS = 8192
#: Rows of a broadcast side of two longs (some 60 bytes each).
KEY_ROWS = 400_000

#: Odd multipliers of the rolling sums (any large odd numbers serve).
BYTES, LANE1, LANE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP = _powers(BYTES, 1 << 16)
_DOWN = _powers(pow(BYTES, -1, 1 << 64), 1 << 16)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of ``data``, and where it starts. Sums of bytes times powers, kept short by counting powers from the start of a block."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    block = 1 << 15
    total = np.zeros(len(raw) + 1, np.uint64)  # of bytes before each place, each with the power of its place in its block
    for at in range(0, len(raw), block):
        part = raw[at : at + block].astype(np.uint64) + np.uint64(1)
        np.cumsum(part * _UP[: len(part)], out=total[at + 1 : at + 1 + len(part)])
    # a block's sums begin anew, so a word's part in each block it touches is taken apart
    first, last = start // block, (end - 1) // block
    one = first == last
    out = np.zeros(len(start), np.uint64)
    s, e = start[one], end[one]
    before = np.where(s % block == 0, np.uint64(0), total[s])
    out[one] = (total[e] - before) * _DOWN[s % block]
    for i in np.flatnonzero(~one):
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "<u8")[0] if end[i] - start[i] > block else _joined(raw[start[i] : end[i]])
    return _mixed(out ^ ((end - start).astype(np.uint64) << np.uint64(40))), start


def _joined(word: np.ndarray) -> np.uint64:
    return ((word.astype(np.uint64) + np.uint64(1)) * _UP[: len(word)]).sum(dtype=np.uint64)


def windows(x: np.ndarray, n: int, base: int) -> np.ndarray:
    """Rolling sums of each ``n`` hashes from each place on (as if zeros followed), by doubling."""
    out, have, factor = np.zeros_like(x), 0, 1
    power, size, times = x, 1, base
    while n:
        if n & 1:
            out = out + _shifted(power, have) * np.uint64(factor)
            have, factor = have + size, factor * times & MASK
        n >>= 1
        if n:
            power = power + _shifted(power, size) * np.uint64(times)
            size, times = 2 * size, times * times & MASK
    return out


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    if not by:
        return x
    out = np.zeros_like(x)
    if by < len(x):
        out[:-by] = x[by:]
    return out


def _running(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """``best`` of x[i], ..., x[i + n - 1] for all i for which these exist."""
    size = 1
    while 2 * size <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Stretches:
    """Word hashes of many stretches, one after another. No window reaches over a stretch's end."""

    def __init__(self, x: np.ndarray, sizes: np.ndarray, window: int):
        self.x, self.window = x, window
        self.end = np.repeat(np.cumsum(sizes), sizes)
        self.whole = np.flatnonzero(np.arange(len(x)) + window <= self.end)  # where windows of full length start

    def least(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``n`` words, and the least of those within each window of full length (by ``whole``)."""
        h = _mixed(windows(self.x, n, LANE1))
        return h, _running(h, self.window - n + 1, np.minimum)[self.whole] if len(self.whole) else h[:0]

    def chosen(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``n`` words that are least somewhere."""
        h, least = self.least(n)
        span = self.window - n + 1
        top = np.zeros(len(h) + span - 1, np.uint64)  # from span - 1 places before
        top[self.whole + span - 1] = least
        at = np.flatnonzero((_running(top, span, np.maximum) == h) & (np.arange(len(h)) + n <= self.end)) if len(least) else self.whole
        return at, h[at]


def _counted(row: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, v) and whether each occurs more than once."""
    by = np.lexsort((v, row))
    row, v = row[by], v[by]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (v[1:] != v[:-1])]) if len(v) else by
    return row[first], v[first], np.diff(first, append=len(v)) > 1


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts in chunks."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        while at < len(ids):
            stop, size = at, 0
            while stop < len(ids) and size < CHUNK:
                size += len(texts[stop] or "")
                stop += 1
            yield ids[at:stop], [(t or "").encode() for t in texts[at:stop]]
            at = stop


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the number of words of each."""
    x, start = word_hashes(b"\n".join(texts))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
    return x, np.diff(np.searchsorted(start, ends), prepend=0)


def _digest(texts: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b" ".join(t.split())).digest() for t in texts]


def _keys(digests: list[bytes]) -> np.ndarray:
    """Two longs of each digest."""
    return np.frombuffer(b"".join(d[:16] for d in digests), np.int64).reshape(-1, 2)


def _first_level(n: int, window: int):
    """Documents (n_words, sha) and the first level's hashes of each (v, twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            x, sizes = _hashed(texts)
            digests = _digest(texts)
            key = _keys(digests)
            s = Stretches(x, sizes, window)
            at, v = s.chosen(n)
            row, v, twice = _counted(np.searchsorted(np.cumsum(sizes), at, side="right"), v)
            d, m = len(ids), len(v)
            columns = [
                pa.array(np.repeat([False, True], [d, m])),
                pa.array([*ids, *[None] * m], pa.int64()),
                pa.array(np.r_[key[:, 0], key[row, 0]]),
                pa.array(np.r_[key[:, 1], key[row, 1]]),
                pa.array(np.r_[sizes, np.zeros(m, np.int64)], pa.int64()),
                pa.array([*digests, *[None] * m], pa.binary()),
                pa.array(np.r_[np.zeros(d, np.uint64), v].view(np.int64)),
                pa.array(np.r_[np.zeros(d, bool), twice]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["is_window", "doc_id", "k1", "k2", "n_words", "sha", "v", "twice"])

    return run


def _text_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _texts(batches):
        key = _keys(_digest(texts))
        yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(texts, pa.binary())], ["k1", "k2", "body"])


def _stretched(x: np.ndarray, base: np.ndarray, starts: np.ndarray, window: int) -> tuple[bytes, bytes, bytes]:
    """The stretches (their first words' places, their sizes, their hashes) that windows at ``starts`` cover. ``base`` has each word's place in its document."""
    cut = np.flatnonzero(np.diff(base[starts]) > window)  # by places: stretches that follow each other here lie apart in the document
    first, end = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + window
    return base[first].astype("<i8").tobytes(), (end - first).astype("<i8").tobytes(), b"".join(x[a:b].tobytes() for a, b in zip(first, end, strict=True))


def _whole_texts(batches: Iterator[tuple]) -> Iterator[tuple]:
    """(ord, hashes, places, sizes, survivors) of rows (ord, body, vs)."""
    for b in batches:
        for i in range(b.num_rows):
            x, _ = word_hashes(b.column(1)[i].as_py())
            yield b.column(0)[i].as_py(), x, np.arange(len(x)), np.array([len(x)]), np.sort(np.array(b.column(2)[i].as_py(), np.int64).view(np.uint64))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The same of rows (ord, starts, sizes, x, vs)."""
    for b in batches:
        for i in range(b.num_rows):
            starts, sizes, x = (np.frombuffer(b.column(k)[i].as_py(), t) for k, t in ((1, "<i8"), (2, "<i8"), (3, "<u8")))
            vs = np.sort(np.array(b.column(4)[i].as_py(), np.int64).view(np.uint64)) if b.num_columns > 4 else None
            yield b.column(0)[i].as_py(), x, np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(x)), sizes, vs


def _gathered(parts: Iterator[list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of some ``ROWS`` rows, or ``CHUNK`` bytes, of the small ones that documents leave."""
    held: list[list[pa.Array]] = []
    rows = size = 0
    for part in parts:
        held.append(part)
        rows, size = rows + len(part[0]), size + sum(c.nbytes for c in part)
        if rows >= ROWS or size >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)
            held, rows, size = [], 0, 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)


def _surviving(s: Stretches, vs: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of full length whose least window of ``n`` words is in ``vs``."""
    _, least = s.least(n)
    at = np.searchsorted(vs, least)
    return s.whole[(at < len(vs)) & (vs[np.minimum(at, len(vs) - 1)] == least)] if len(vs) else s.whole[:0]


def _extended(read, n: int, window: int):
    """The stretches that the survivors of ``n`` words leave."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for order, x, place, sizes, vs in read(batches):
            starts = _surviving(Stretches(x, sizes, window), vs, n)
            if len(starts):
                yield [pa.array([order], pa.int64()), *[pa.array([c], pa.binary()) for c in _stretched(x, place, starts, window)]]

    return lambda batches: _gathered(parts(batches), ["ord", "starts", "sizes", "x"])


def _next_level(n: int, window: int):
    """Hashes (ord, v, twice) of windows of ``n`` words of the stretches."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for order, x, _, sizes, _ in _parts(batches):
            _, v = Stretches(x, sizes, window).chosen(n)
            _, v, twice = _counted(np.zeros(len(v), np.int64), v)
            yield [pa.array(np.full(len(v), order, np.int64)), _long(v), pa.array(twice)]

    return lambda batches: _gathered(parts(batches), ["ord", "v", "twice"])


def _last_level(read, n: int, window: int):
    """(ord, h1, h2, start) of the first window of each sequence in a document; rows without h1 have the starts of those that follow it there."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for order, x, place, sizes, vs in read(batches):
            at = _surviving(Stretches(x, sizes, window), vs, n)
            h1, h2 = (_mixed(windows(x, window, base))[at] for base in (LANE1, LANE2))
            start = place[at]
            by = np.lexsort((start, h2, h1))
            h1, h2, start = h1[by], h2[by], start[by]
            again = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])] if len(h1) else np.zeros(0, bool)
            m, late = int((~again).sum()), np.sort(start[again])
            yield [pa.array(np.full(m, order, np.int64)), _long(h1[~again]), _long(h2[~again]), pa.array(start[~again], pa.int64()), pa.nulls(m, pa.binary())]
            if len(late):
                yield [pa.array([order], pa.int64()), *[pa.nulls(1, pa.int64())] * 3, pa.array([late.astype("<i8").tobytes()], pa.binary())]

    return lambda batches: _gathered(parts(batches), ["ord", "h1", "h2", "start", "late"])


def _without(window: int):
    """Rows (k1, k2, body, starts, late) to what is kept of them."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            for i in range(b.num_rows):
                words = b.column(2)[i].as_py().split()
                starts = np.concatenate([np.array(b.column(3)[i].as_py(), np.int64), *[np.frombuffer(x, "<i8") for x in b.column(4)[i].as_py()]])
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + window, -1)
                kept = np.cumsum(steps[:-1]) == 0
                text = b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])
                yield [b.column(0)[i : i + 1], b.column(1)[i : i + 1], pa.array([int((~kept).sum())], pa.int64()), pa.array([hashlib.sha256(text).digest()]), pa.array([text.decode()])]

    return lambda batches: _gathered(parts(batches), ["k1", "k2", "removed", "kept_sha", "kept_text"])


def _repeated(found: DataFrame, own: list[str], name: str) -> DataFrame:
    """``own``, vs: the hashes of each document that others have, too, or that it has twice. ``found`` has a row for each hash of a document."""
    shared = found.groupBy("v").agg(F.min(own[0]).alias("a"), F.max(own[0]).alias("b"), F.min(own[-1]).alias("c"), F.max(own[-1]).alias("d"), F.max("twice").alias("twice"))
    shared = shared.where("a <> b OR c <> d OR twice").select("v")
    return materialize(found.select(*own, "v").join(shared.hint("merge"), "v").groupBy(*own).agg(F.collect_set("v").alias("vs")), f"repeats-{name}")


def without_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, and kept_text, which is null where nothing or everything is removed (the words as they are, or '')."""
    levels = [first]
    while levels[-1] < window:
        levels.append(2 * levels[-1])
    if levels[-1] != window or len(levels) < 2:
        raise ValueError("window must be first, doubled once or more")
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "is_window boolean, doc_id long, k1 long, k2 long, n_words long, sha binary, v long, twice boolean"
    both = materialize(text.mapInArrow(_first_level(first, window), schema), "repeats-first")
    rows = both.where(~F.col("is_window")).groupBy("doc_id", "k1", "k2", "n_words", "sha").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows, "repeats-documents")
    # the first document of each word sequence, numbered in the order of documents (numbers of a sorted frame rise)
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("o")
    heads = rows.where(F.col("n_words") >= window).groupBy("k1", "k2").agg(order).select("k1", "k2", F.col("o.col1").alias("none"), F.col("o.doc_id").alias("head_id"))
    heads = materialize(heads.orderBy("none", "head_id", "k1", "k2").withColumn("ord", F.monotonically_increasing_id()), "repeats-heads")
    survivors = _repeated(both.where("is_window"), ["k1", "k2"], "survivors").join(heads.select("k1", "k2", "ord"), ["k1", "k2"])
    bodies = text.mapInArrow(_text_keys, "k1 long, k2 long, body binary")
    source = _once(bodies, survivors.select("k1", "k2")).join(survivors, ["k1", "k2"]).select("ord", "body", "vs")
    read = _whole_texts
    for n in levels[:-2]:
        parts = materialize(source.mapInArrow(_extended(read, n, window), "ord long, starts binary, sizes binary, x binary"), f"repeats-{2 * n}")
        vs = _repeated(parts.mapInArrow(_next_level(2 * n, window), "ord long, v long, twice boolean"), ["ord"], f"survivors-{2 * n}")
        source, read = parts.join(vs, "ord").select("ord", "starts", "sizes", "x", "vs"), _parts
    last = materialize(source.mapInArrow(_last_level(read, levels[-2], window), "ord long, h1 long, h2 long, start long, late binary"), "repeats-last")
    own = last.where(F.col("h1").isNotNull()).select("h1", "h2", "ord", "start")
    earliest = own.groupBy("h1", "h2").agg(F.min("ord").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "earliest")
    later = own.join(earliest.hint("merge"), ["h1", "h2"]).where("ord > earliest").select("ord", "start", F.lit(None).cast("binary").alias("late"))
    within = last.where(F.col("h1").isNull()).select("ord", F.lit(None).cast("long").alias("start"), "late")
    cut = later.unionByName(within).groupBy("ord").agg(F.collect_list("start").alias("starts"), F.collect_list("late").alias("late"))
    cut = materialize(cut.join(heads.select("ord", "k1", "k2"), "ord").select("k1", "k2", "starts", "late"), "repeats-cut")
    kept = _once(bodies, cut.select("k1", "k2")).join(cut, ["k1", "k2"]).select("k1", "k2", "body", "starts", "late")
    kept = kept.mapInArrow(_without(window), "k1 long, k2 long, removed long, kept_sha binary, kept_text string")
    # all but one of a word sequence's rows keep nothing
    short = rows.where(F.col("n_words") < window).withColumns({"head": F.lit(True), "removed": F.lit(None).cast("long"), "kept_sha": F.lit(None).cast("binary"), "kept_text": F.lit(None).cast("string"), "times": F.col("copies")})
    met = rows.where(F.col("n_words") >= window).join(heads.select("k1", "k2", "head_id"), ["k1", "k2"])
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id"))
    own_rows = met.where(is_head).join(kept, ["k1", "k2"], "left").withColumns({"head": F.lit(True), "times": F.lit(1).cast("long")})
    nothing = {"head": F.lit(False), "removed": F.lit(None).cast("long"), "kept_sha": F.lit(None).cast("binary"), "kept_text": F.lit(None).cast("string"), "times": F.col("copies") - is_head.cast("long")}
    others = met.withColumns(nothing).where("times > 0")
    names = ["doc_id", "n_words", "sha", "head", "removed", "kept_sha", "kept_text", "times"]
    out = short.select(*names).unionByName(own_rows.select(*names)).unionByName(others.select(*names))
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("head"), F.coalesce("removed", F.lit(0))).otherwise(F.col("n_words")).alias("n_removed"),
        F.when(F.col("head"), F.lower(F.hex(F.coalesce("kept_sha", "sha")))).otherwise(empty).alias("kept_sha256"),
        F.when(F.col("head"), F.col("kept_text")).otherwise(F.lit("")).alias("kept_text"),
    )


def _once(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """One body of each wanted word sequence. Few of them go to the documents, so that the rest of the texts stays; copies are dropped before the shuffle."""
    return bodies.join(small_side(wanted, wanted.count(), KEY_ROWS), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("body").alias("body"))
