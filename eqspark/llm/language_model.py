"""Recurrent language-model scoring: a gated recurrent network with a class-factored softmax, in numpy.

Counts of every training word come from the whole corpus. The most frequent words (``SHORT`` at least, more as the vocabulary
grows) and the document end form frequency classes, each word with its own output within its class; every other word belongs to one of a few tail classes by its
form (length, last character, non-ASCII letters), and within such a class a word has its add-one corpus frequency. A token's
probability is P(class | state) * P(word | class, state). The network is trained by truncated backpropagation
on all training documents: it starts from ``EPOCHS`` epochs on the driver over a sample of at most ``TRAIN_TOKENS`` tokens, and then
every training token is passed once by distributed workers, in ``ROUNDS`` rounds whose weights are averaged by tokens. Scoring carries the
state over windows from a document's first token to its end, so a score is the log-likelihood of the whole text.

At most ``HOT`` words of at most ``HOT_BYTES`` bytes are broadcast, those above a count that a histogram of counts gives. Other words' counts are joined
to their documents by a shuffle. Memory of scoring is a window of ``SCORE_WINDOW`` steps by ``SCORE_LANES`` texts beside the tokens of a chunk and ``HELD_TOKENS`` that wait, or one text, however long it is.

Edge cases: a null or empty text is its end token alone; repeated rows are scored each; a null doc_id is scored and, as
crc32 of null is not 2 modulo 7, learned from; with no training rows N and V are 0 and every token has
probability 1 in the base (log10(1/1)); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import materialize

HELD_OUT_MOD, HELD_OUT_REST = 7, 2
#: The short list of a small vocabulary and its classes; ``short_size`` grows both.
SHORT = 2000
N_CLASSES = 40
HOT, HOT_BYTES = 100_000, 64
#: Counts are put into so many bins an octave to find the least count of a broadcast word.
COUNT_BINS = 64
#: The sample that gives the first weights; all training tokens follow.
TRAIN_TOKENS = 600_000
TRAIN_DOCS = 2000
EPOCHS = 2
#: Tokens that one worker trains on between two averages, and averages in the pass over all training tokens.
SHARD_TOKENS = 2_000_000
ROUNDS = 4
RATE, PASS_RATE = 0.008, 0.012
EMBED, HIDDEN = 24, 32
LANES, WINDOW = 64, 32
#: Lanes of the pass over all training tokens: steps of more lanes cost less a token.
PASS_LANES = 256
SCORE_LANES, SCORE_WINDOW = 256, 32
CHUNK_TOKENS = 400_000
#: Tokens whose words are counted at once.
COUNT_TOKENS = 3_000_000
#: Tokens of texts that are begun or dealt which may wait for more texts.
HELD_TOKENS = 2_000_000
#: Rows of logits that are made at once: they stay in a core's cache.
ROWS = 2048
#: The end token; words hold no space.
END = b" "
N_TAIL = 18


def tail_class(word: bytes) -> int:
    n, last = len(word), word[-1]
    return (0 if n <= 4 else 1 if n <= 8 else 2) * 6 + (0 if last == 46 else 1 if last == 44 else 2) * 2 + (not word.isascii())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z) without the end token."""
    return text.encode().lower().split() if text else []


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of a column: the words (binary) of all texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # before white space that begins a text, and after what ends it
    if empty.any():
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    return words.cast(pa.binary()), sizes


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each of ``words`` (binary, none empty)."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, edges, data = words.buffers()
    edges = np.frombuffer(edges, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    n, last, ascii_ = np.diff(edges), data[edges[1:] - 1], np.maximum.reduceat(data, edges[:-1]) < 128
    return (np.where(n <= 4, 0, np.where(n <= 8, 1, 2)) * 6 + np.where(last == 46, 0, np.where(last == 44, 1, 2)) * 2 + ~ascii_).astype(np.int32)


def pieces(texts: pa.Array, n_tokens: int) -> Iterator[slice]:
    """Stretches of a column of about ``n_tokens`` tokens, whole texts."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // (6 * n_tokens)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in pieces(b.column(0), COUNT_TOKENS):
            words, sizes = split(b.column(0)[at])
            found = pc.value_counts(words)
            values = found.field(0)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([values, pa.array([END], pa.binary())]), pa.array(np.append(tail_classes(values), -1), pa.int32()), pa.concat_arrays([found.field(1).cast(pa.int64()), pa.array([len(sizes)], pa.int64())])], ["word", "tail", "c"])


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes), tail, c over the training documents."""
    train = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string"))
    return train.mapInArrow(_count, "word binary, tail int, c long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def short_size(types: int) -> tuple[int, int]:
    """(words, classes) of the short list: twice the root of the number of distinct words, ``SHORT`` at least and ``HOT`` at most; classes by the root."""
    short = min(HOT, max(SHORT, 2 * math.isqrt(types)))
    return short, round(N_CLASSES * math.sqrt(short / SHORT))


class Vocabulary:
    """Ids: 0 the end, 1..short words by frequency, then one for each tail class. Bounded by ``HOT``."""

    def __init__(self, hot: list[tuple[bytes, int]], end_count: int, tails: dict[int, tuple[int, int]], short: int = SHORT, n_classes: int = N_CLASSES):
        self.words = [w for w, _ in hot[:short]]
        counts = np.array([max(end_count, 1), *(c for _, c in hot[:short])], np.float64)
        # frequency classes: equal shares of the root of the counts, so that frequent words have small classes
        share = np.cumsum(np.sqrt(counts)) / np.sqrt(counts).sum()
        of = np.minimum((share * n_classes - 1e-9).astype(int), n_classes - 1)
        self.class_of = np.unique(of, return_inverse=True)[1].astype(np.int32)
        self.n_short = len(counts)
        self.n_freq = int(self.class_of.max()) + 1
        self.first = np.searchsorted(self.class_of, np.arange(self.n_freq + 1)).astype(np.int32)
        self.n_out = self.n_freq + N_TAIL
        total = {t: list(tails.get(t, (0, 0))) for t in range(N_TAIL)}
        for w, c in hot[:short]:
            t = total[tail_class(w)]
            t[0] -= c
            t[1] -= 1
        self.tail_base = np.array([-np.log(total[t][0] + total[t][1] + 1.0) for t in range(N_TAIL)])
        self.ids = {w: i + 1 for i, w in enumerate(self.words)}
        self.counts = dict(hot)
        self.end_count = end_count

    def class_of_ids(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.n_short, self.class_of[np.minimum(ids, self.n_short - 1)], ids - self.n_short + self.n_freq)


def initial(vocabulary: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n_in = vocabulary.n_short + N_TAIL
    w = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return {"e": w(n_in, EMBED, s=0.3), "wx": w(EMBED, 3 * HIDDEN, s=EMBED**-0.5), "b": np.zeros(3 * HIDDEN, np.float32), "u": w(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5), "wc": w(HIDDEN, vocabulary.n_out, s=0.05), "bc": np.zeros(vocabulary.n_out, np.float32), "wo": w(HIDDEN, vocabulary.n_short, s=0.05), "bo": np.zeros(vocabulary.n_short, np.float32)}


def _small(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether no logit can come near overflow: states lie within -1 and 1."""
    return float((np.abs(w).sum(axis=0) + np.abs(b)).max(initial=0)) < 60


def _exponents(logits: np.ndarray, axis: int, small: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """Exponentials of ``logits``, in their place, and what was taken off before: their maximum, where they may be large."""
    top = 0.0 if small else logits.max(axis=axis, keepdims=True)
    if not small:
        logits -= top
    return np.exp(logits, out=logits), top if small else top.squeeze(axis)


def _by_class(target: np.ndarray, classes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Rows whose target is a word of a class of several words, by class; where each lies in its class's block (words of the class times its rows); and words and rows of each class: first and end."""
    few = np.flatnonzero((np.diff(v.first) > 1)[np.minimum(classes, v.n_freq - 1)] & (classes < v.n_freq))
    order = few[np.argsort(classes[few].astype(np.int16), kind="stable")]
    of = classes[order]
    size = np.bincount(of, minlength=v.n_freq)
    start = np.cumsum(size) - size
    place = (target[order] - v.first[of]) * size[of] + np.arange(len(order)) - start[of]
    at = np.flatnonzero(size)
    return order, place, list(zip(v.first[at].tolist(), v.first[at + 1].tolist(), start[at].tolist(), (start + size)[at].tolist(), strict=True))


def log_likelihood(h: np.ndarray, target: np.ndarray, w: dict[str, np.ndarray], v: Vocabulary) -> np.ndarray:
    """Natural log of P(class) and, for short-list words, P(word | class) for states ``h`` (n, H) by ``scoring_weights``."""
    classes = v.class_of_ids(target)
    out = np.empty(len(target))
    for at in range(0, len(target), ROWS):
        logits = h[at : at + ROWS] @ w["wc"]
        logits += w["bc"]
        own = logits[np.arange(len(logits)), classes[at : at + ROWS]]
        e, top = _exponents(logits, 1, w["small"])
        out[at : at + ROWS] = own - top - np.log(e @ np.ones(e.shape[1], e.dtype))
    order, place, blocks = _by_class(target, classes, v)
    states, own, sums = h.take(order, axis=0), np.empty(len(order), np.float32), np.empty(len(order), np.float32)
    for a, b, i, j in blocks:
        logits = w["wo"][a:b] @ states[i:j].T
        logits += w["bo"][a:b]
        logits.take(place[i:j], out=own[i:j], mode="clip")
        e, top = _exponents(logits, 0, w["small"])
        np.add.reduce(e, axis=0, out=sums[i:j])
        own[i:j] -= top
    out[order] += own - np.log(sums)
    return out


def train(sequences: list[np.ndarray], v: Vocabulary, epochs: int = EPOCHS, lanes: int = LANES, window: int = WINDOW, start: dict[str, np.ndarray] | None = None, rates: tuple[float, float] = (RATE, 0.1 * RATE)) -> dict[str, np.ndarray]:
    """Truncated backpropagation over documents laid end to end in ``lanes``; the state is carried over windows and reset at documents.

    Starts from the weights ``start``, or anew; the learning rate falls from the first to the last of ``rates``.
    """
    p = initial(v) if start is None else {k: x.copy() for k, x in start.items()}
    if not sequences:
        return p
    flat = np.concatenate(sequences)
    if start is None:
        freq = np.bincount(v.class_of_ids(flat), minlength=v.n_out) + 1.0
        p["bc"] = np.log(freq / freq.sum()).astype(np.float32)
        words = np.bincount(np.minimum(flat, v.n_short), minlength=v.n_short + 1)[: v.n_short] + 1.0
        p["bo"] = np.log(words).astype(np.float32)
    starts = np.zeros(len(flat), bool)
    starts[np.cumsum([0, *map(len, sequences[:-1])])] = True
    lanes = max(1, min(lanes, len(flat) // window))
    n = -(-len(flat) // lanes)  # what does not fill the last lane is filled from the start, so no token is left out
    flat, starts = np.resize(flat, n * lanes), np.resize(starts, n * lanes)
    y = flat[: n * lanes].reshape(lanes, n).T
    begin = starts[: n * lanes].reshape(lanes, n).T.copy()
    begin[0] = True
    x = np.zeros_like(y)  # the token before, the end token at a document's start
    x[1:] = y[:-1]
    x[begin] = 0
    best, adam, layer = p, gru.Adam(p, rates[0]), gru.Layer(window, lanes, HIDDEN, True)
    steps = epochs * -(-n // window)
    for epoch in range(epochs):
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, n, window):
            adam.rate = rates[0] + (rates[1] - rates[0]) * adam.t / steps
            h = _train_window(x[at : at + window], y[at : at + window], begin[at : at + window], h, p, v, adam, layer)
    return best


def _train_window(x, y, begin, h, p, v: Vocabulary, adam: gru.Adam, layer: gru.Layer) -> np.ndarray:
    steps, lanes = x.shape
    states = layer.forward(gru.gatewise(p["e"] @ p["wx"] + p["b"]), x, h, gru.gatewise(p["u"]), begin)
    flat, target = states.reshape(-1, HIDDEN), y.reshape(-1)
    classes, n = v.class_of_ids(target), len(target)
    share = np.float32(1 / n)
    small = _small(p["wc"], p["bc"]) and _small(p["wo"], p["bo"])
    g = {"wc": np.zeros_like(p["wc"]), "bc": np.zeros_like(p["bc"]), "bo": np.zeros_like(p["bo"])}
    dflat, turned = np.empty_like(flat), np.ascontiguousarray(p["wc"].T)
    for at in range(0, n, ROWS):
        own = flat[at : at + ROWS]
        d = own @ p["wc"]
        d += p["bc"]
        _exponents(d, 1, small)
        d *= (share / (d @ np.ones(d.shape[1], d.dtype)))[:, None]
        d[np.arange(len(d)), classes[at : at + ROWS]] -= share
        g["wc"] += own.T @ d
        g["bc"] += np.ones(len(d), d.dtype) @ d
        np.matmul(d, turned, out=dflat[at : at + ROWS])
    order, place, blocks = _by_class(target, classes, v)
    sorted_states, back = flat.take(order, axis=0), np.empty((len(order), HIDDEN), np.float32)
    wo, gwo, bo = np.ascontiguousarray(p["wo"].T), np.zeros((v.n_short, HIDDEN), np.float32), p["bo"][:, None]
    for a, b, i, j in blocks:
        own = sorted_states[i:j]
        d = wo[a:b] @ own.T
        d += bo[a:b]
        _exponents(d, 0, small)
        d *= share / np.add.reduce(d, axis=0)
        d.reshape(-1)[place[i:j]] -= share
        np.matmul(d, own, out=gwo[a:b])
        np.add.reduce(d, axis=1, out=g["bo"][a:b])
        np.matmul(d.T, wo[a:b], out=back[i:j])
    dflat[order] += back
    g["wo"] = np.ascontiguousarray(gwo.T)
    h = states[-1].copy()
    dxg, g["u"] = layer.backward(dflat.reshape(steps, lanes, HIDDEN), p["u"], begin)
    dn, dr, dz = (d.reshape(-1, HIDDEN) for d in dxg)
    read = np.concatenate([p["e"], np.ones((len(p["e"]), 1), np.float32)], axis=1).take(x.reshape(-1), axis=0).T  # the last is for the bias
    own = np.concatenate([read @ d for d in (dr, dz, dn)], axis=1)
    g["wx"], g["b"] = np.ascontiguousarray(own[:-1]), own[-1].copy()
    wr, wz, wn = (np.ascontiguousarray(w.T) for w in np.split(p["wx"], 3, axis=1))
    de = dr @ wr
    de += dz @ wz
    de += dn @ wn
    ids = x.reshape(-1).astype(np.uint16 if len(p["e"]) <= 1 << 16 else np.int32)  # short ones sort by their digits
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    g["e"] = np.zeros_like(p["e"])
    g["e"][ids[first]] = np.add.reduceat(de.take(order, axis=0), first, axis=0)
    adam.update(g)
    return h


def scoring_weights(p: dict[str, np.ndarray]) -> dict[str, np.ndarray | bool]:
    return {"xg": gru.gatewise(p["e"] @ p["wx"] + p["b"]), "u": gru.gatewise(p["u"]), "wc": p["wc"], "bc": p["bc"], "wo": np.ascontiguousarray(p["wo"].T), "bo": p["bo"][:, None], "small": _small(p["wc"], p["bc"]) and _small(p["wo"], p["bo"])}


@dataclass
class _Text:
    """A text that is being scored: its tokens still to come, the one before them (-1: it has not begun) and the log-likelihood of those that were."""

    key: int
    ids: np.ndarray
    before: int = -1
    total: float = 0.0


class Scorer:
    """Scores texts of very different lengths in ``lanes`` that stay full.

    A lane takes one text after another. When the shortest lane of those dealt is through, the others keep the rest of theirs until more texts come, so
    that a long text does not run on alone. At most ``held`` tokens wait so, or lanes run on in part.
    """

    def __init__(self, w: dict, v: Vocabulary, lanes: int = SCORE_LANES, window: int = SCORE_WINDOW, held: int = HELD_TOKENS):
        self.w, self.v, self.lanes, self.window, self.most = w, v, lanes, window, held
        self.begun: list[_Text | None] = [None] * lanes
        self.waiting: list[_Text] = []
        self.h = np.zeros((lanes, HIDDEN), np.float32)
        self.layer = gru.Layer(window, lanes, HIDDEN, False)
        self.steps = 0

    def score(self, texts: list[tuple[int, np.ndarray]], last: bool) -> Iterator[tuple[int, float]]:
        """(key, log-likelihood) of the texts (key, ids) that come to their end now; all that are left with the ``last``."""
        self.waiting += [_Text(*t) for t in texts]
        dealt = [[t] if t else [] for t in self.begun]
        loads = [(len(d[0].ids) if d else 0, i) for i, d in enumerate(dealt)]
        heapq.heapify(loads)
        for t in sorted(self.waiting, key=lambda t: -len(t.ids)):
            load, i = loads[0]
            dealt[i].append(t)
            heapq.heapreplace(loads, (load + len(t.ids), i))
        lengths = np.zeros(self.lanes, np.int64)
        for load, i in loads:
            lengths[i] = load
        steps = self._until(lengths, last)
        if not steps:
            return
        order = np.argsort(-lengths, kind="stable")
        self.waiting, self.begun = [], [None] * self.lanes
        totals = iter(self._run([t for i in order for t in dealt[i]], order, lengths[order], steps))
        for i in order:
            at = 0
            for t in dealt[i]:
                t.total, left = next(totals), steps - at
                at += len(t.ids)
                if at <= steps:
                    yield t.key, t.total
                elif left > 0:
                    self.begun[i] = _Text(t.key, t.ids[left:], int(t.ids[left - 1]), t.total)
                else:
                    self.waiting.append(t)

    def _until(self, lengths: np.ndarray, last: bool) -> int:
        if last:
            return int(lengths.max())
        least, most = int(lengths.min()), int(lengths.max())
        if lengths.sum() - self.lanes * least > self.most:  # the fewest steps that leave half of it
            while least < most:
                middle = (least + most) // 2
                least, most = (least, middle) if np.maximum(lengths - middle, 0).sum() <= self.most // 2 else (middle + 1, most)
        return least

    def _run(self, texts: list[_Text], order: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
        """Totals of ``texts``, lane by lane, after ``steps``; ``lengths`` fall."""
        sizes = np.array([len(t.ids) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        before = np.array([t.before for t in texts])
        y = np.concatenate([t.ids for t in texts])
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        begin = np.zeros(len(y), bool)
        begin[starts[before < 0]] = True
        x = np.zeros_like(y)
        x[1:] = y[:-1]
        x[starts] = np.maximum(before, 0)
        total = np.array([t.total for t in texts])
        ends = np.cumsum(lengths)
        first = ends - lengths
        h = self.h[order]
        for at in range(0, steps, self.window):
            live = int(np.searchsorted(-lengths, -at))  # lanes that go on
            place = first[:live] + np.arange(at, min(at + self.window, steps))[:, None]
            over = place >= ends[:live]
            np.minimum(place, ends[:live] - 1, out=place)
            states = self.layer.forward(self.w["xg"], x[place], h[:live], self.w["u"], begin[place])
            self.steps += len(place)
            found = log_likelihood(states.reshape(-1, HIDDEN), y[place].reshape(-1), self.w, self.v)
            found[over.reshape(-1)] = 0
            total += np.bincount(owner[place].reshape(-1), found, len(texts))
            h[:live] = states[-1]
        self.h[order] = h
        return total


def score_sequences(sequences: list[np.ndarray], w: dict, v: Vocabulary, lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Log-likelihood (natural) of each whole sequence of ids, each ending with 0."""
    out = np.zeros(len(sequences))
    for i, x in Scorer(w, v, max(1, min(lanes, len(sequences))), window).score(list(enumerate(sequences)), True):
        out[i] = x
    return out


def _to_ids(words: list[bytes], v: Vocabulary) -> np.ndarray:
    get, base = v.ids.get, v.n_short
    return np.array([get(w) or base + tail_class(w) for w in words] + [0], np.int32)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hot_logs = shared.value["v"], shared.value["logs"]
        hot, base = shared.value["hot"], v.n_short
        tail_of_hot, tail_base = shared.value["tails"], v.tail_base
        scorer = Scorer(shared.value["w"], v)
        known_of: dict[int, tuple] = {}  # of texts whose end is still to come
        n = 0

        def read(doc_ids: list, texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
            words, sizes = split(texts)
            at = pc.fill_null(pc.index_in(words, hot), -1).to_numpy(zero_copy_only=False)
            ids = np.where(at < base - 1, at + 1, base + tail_of_hot[at]).astype(np.int32)  # what is not hot is set next
            unknown = np.flatnonzero(at < 0)
            found = words.take(pa.array(unknown))
            ids[unknown] = base + tail_classes(found)
            found, row, logs = found.to_pylist(), np.repeat(np.arange(len(sizes)), sizes), hot_logs[at]  # zero where a word is not hot
            tail = np.flatnonzero(ids >= base)
            sums = np.bincount(row, logs, len(sizes)).tolist()
            tail_sums = np.bincount(row[tail], logs[tail] + tail_base[ids[tail] - base], len(sizes)).tolist()
            edges = np.cumsum([0, *sizes.tolist()])
            cuts = np.searchsorted(unknown, edges).tolist()
            for i, (doc_id, size) in enumerate(zip(doc_ids, sizes.tolist(), strict=True)):
                rare = Counter(found[cuts[i] : cuts[i + 1]])
                known_of[n + i] = (doc_id, size + 1, size - cuts[i + 1] + cuts[i], sums[i], tail_sums[i], list(rare), list(rare.values()))
                yield n + i, np.append(ids[edges[i] : edges[i + 1]], np.int32(0))

        def score(texts: list[tuple[int, np.ndarray]], last: bool) -> Iterator[pa.RecordBatch]:
            found = list(scorer.score(texts, last))
            if found:
                doc_ids, sizes, hot, logs, tail_logs, rare, times = zip(*(known_of.pop(k) for k, _ in found), strict=True)
                edges = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array([*chain.from_iterable(x)], t)) for x, t in ((rare, pa.binary()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hot, pa.int64()), pa.array(logs, pa.float64()), pa.array(tail_logs, pa.float64()), pa.array([x for _, x in found], pa.float64()), *lists],
                    ["doc_id", "n_tokens", "n_hot", "logs", "tail_logs", "model", "rare", "times"],
                )

        for b in batches:
            order = np.argsort(-pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), kind="stable")  # the longest first, so that none of them is left to run on alone
            b = b.take(pa.array(order))
            for at in pieces(b.column(1), CHUNK_TOKENS):
                texts = list(read(b.column(0)[at].to_pylist(), b.column(1)[at], n))
                n += len(texts)
                yield from score(texts, False)
        yield from score([], True)

    return run


SCORED = "doc_id long, n_tokens long, n_hot long, logs double, tail_logs double, model double, rare array<binary>, times array<int>"


def _sampler(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_to_ids(tokens(t), v).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["h", "ids"])

    return run


def sample(docs: DataFrame, v: Vocabulary, n_docs: int) -> list[np.ndarray]:
    """Id sequences of about ``TRAIN_DOCS`` of the ``n_docs`` training documents (never more), those with the smallest hashes of id and text, up to ``TRAIN_TOKENS`` tokens; equal rows count once."""
    if not n_docs:
        return []
    h = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit("lm"))
    rows = docs.where(~held_out(F.col("doc_id"))).select(h.alias("h"), F.col("text").cast("string"))
    share = 0.9 * TRAIN_DOCS / n_docs
    few = rows if n_docs <= TRAIN_DOCS else rows.where(F.col("h") <= int(-(2**63) + share * 2**64))
    few = few.mapInArrow(_sampler(v), "h long, ids binary").groupBy("h").agg(F.first("ids").alias("ids"))
    found, n = [], 0
    for row in few.sort("h").limit(TRAIN_DOCS).toLocalIterator():
        found.append(np.frombuffer(row["ids"], np.int32))
        n += len(found[-1])
        if n >= TRAIN_TOKENS:
            break
    return found


def _pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)]).astype(np.float64)


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _part_trainer(shared, chunk_tokens: int):
    """Weights times tokens of each chunk of a shard, trained from the shared weights. A shard is one chunk unless rows repeat greatly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p, rates = shared.value["v"], shared.value["p"], shared.value["rates"]
        found: list[np.ndarray] = []
        n, now, chunk = 0, None, 0

        def done() -> pa.RecordBatch:
            w = _pack(train(found, v, 1, PASS_LANES, start=p, rates=rates)) * n
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([chunk], pa.int64()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["shard", "chunk", "n", "w"])

        for b in batches:
            for shard, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if found and (shard != now or n >= chunk_tokens):
                    yield done()
                    found, n, chunk = [], 0, chunk + 1 if shard == now else 0
                now = shard
                found.append(np.frombuffer(ids, np.int32))
                n += len(found[-1])
        if found:
            yield done()

    return run


PART = "shard long, chunk long, n long, w binary"


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w, n, first = None, 0, None
    for b in batches:
        for shard, size, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            x = np.frombuffer(x.as_buffer(), np.float64)
            w, n, first = x if w is None else w + x, n + size, shard if first is None else first
    if w is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([0], pa.int64()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["shard", "chunk", "n", "w"])


def train_all(docs: DataFrame, v: Vocabulary, start: dict[str, np.ndarray], n_tokens: int, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], int]:
    """(weights, tokens trained on) after a pass over all training documents.

    Documents are dealt into shards of about ``shard_tokens`` by a hash of id and text, so weights do not depend on the table's layout. In each
    round the workers train its shards from the same weights, and the average by tokens starts the next round.
    """
    spark = docs.sparkSession
    shards = -(-n_tokens // shard_tokens)
    rounds = min(rounds, shards)
    context = spark.sparkContext
    short, base = context.broadcast(pa.array(v.words, pa.binary())), v.n_short

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b.column(1), CHUNK_TOKENS):
                words, sizes = split(b.column(1)[part])
                ids = pc.fill_null(pc.index_in(words, short.value), -1).to_numpy(zero_copy_only=False) + np.int32(1)
                tail = np.flatnonzero(ids == 0)
                ids[tail] = base + tail_classes(words.take(pa.array(tail)))
                edges = np.cumsum([0, *sizes.tolist()]).tolist()
                out = [np.append(ids[i:j], np.int32(0)).tobytes() for i, j in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(out, pa.binary())], ["h", "ids"])

    h = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit("lm-pass"))
    rows = docs.where(~held_out(F.col("doc_id"))).select(h.alias("h"), F.col("text").cast("string"))
    dealt = rows.mapInArrow(to_ids, "h long, ids binary").withColumn("shard", F.pmod("h", F.lit(shards)))
    dealt = materialize(dealt.withColumn("round", F.pmod("shard", F.lit(rounds))), "lm-ids")
    lean = Vocabulary.__new__(Vocabulary)
    lean.__dict__ |= {k: x for k, x in v.__dict__.items() if k not in ("words", "ids", "counts")}
    p, seen = start, 0
    for r in range(rounds):
        rates = tuple(PASS_RATE * (1 - 0.9 * k / rounds) for k in (r, r + 1))
        shared = context.broadcast({"v": lean, "p": p, "rates": rates})
        here = -(-(shards - r) // rounds)
        part = F.floor(F.col("shard") / rounds).cast("int")
        mine = dealt.where(F.col("round") == r).repartitionById(here, part).sortWithinPartitions("shard", "h", "ids").select("shard", "ids")
        parts = materialize(mine.mapInArrow(_part_trainer(shared, 2 * shard_tokens), PART), "lm-part")
        groups = max(1, math.isqrt(here))
        sums = parts.repartitionById(groups, F.pmod(F.floor(F.col("shard") / rounds), F.lit(groups)).cast("int")).sortWithinPartitions("shard", "chunk").mapInArrow(_add_parts, PART)
        total, n = None, 0
        for row in materialize(sums, "lm-sum").sort("shard").toLocalIterator():
            x = np.frombuffer(row["w"], np.float64)
            total, n = x if total is None else total + x, n + row["n"]
        if n:
            p, seen = _unpack(total / n, p), seen + n
    return p, seen


def hot_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, count), by falling count, of the words whose count is at least the least one that at most ``most`` words reach.

    The least count comes from a histogram (one row a bin, some thousands at most), so neither driver nor any task gets more than ``most`` words.
    """
    short = counts.where((F.col("tail") >= 0) & (F.octet_length("word") <= HOT_BYTES))
    octave = F.floor(COUNT_BINS * F.log2(F.col("c").cast("double"))).cast("int")
    bins = sorted(((r["b"], r["n"]) for r in short.groupBy(octave.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, n = None, 0
    for b, size in bins:
        n += size
        if n > most:
            break
        least = b
    if least is None:
        return []
    found = [(bytes(r["word"]), r["c"]) for r in short.where(octave >= least).select("word", "c").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


@dataclass
class Model:
    """What ``fit`` learns: counts of all training words and the trained network."""

    counts: DataFrame
    total: int
    types: int
    end_count: int
    hot: list[tuple[bytes, int]]
    vocabulary: Vocabulary
    weights: dict[str, np.ndarray]


def fit(docs: DataFrame) -> Model:
    """Counts and network of the training rows of ``docs`` (doc_id, text)."""
    counts = materialize(count_words(docs), "lm-counts")
    tails = {r["tail"]: (r["n"], r["v"]) for r in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total, types = sum(n for n, _ in tails.values()), sum(v for _, v in tails.values())
    end_count = tails.pop(-1, (0, 0))[0]
    hot = hot_words(counts, HOT)
    v = Vocabulary(hot, end_count, tails, *short_size(types))
    first = sample(docs, v, end_count)
    trained = train(first, v)
    if sum(map(len, first)) < total:
        trained, _ = train_all(docs, v, trained, total)
    return Model(counts, total, types, end_count, hot, v, trained)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_with(docs, fit(docs))


def score_with(docs: DataFrame, model: Model) -> DataFrame:
    """``score_documents`` by a fitted model; ``docs`` has doc_id (long) and text."""
    counts, total, types, end_count, hot, v = model.counts, model.total, model.types, model.end_count, model.hot, model.vocabulary
    logs = np.log(np.array([c + 1.0 for _, c in hot] + [1.0]))  # the last is of words that are not hot
    tail_of_hot = np.array([tail_class(w) for w, _ in hot] + [0], np.int32)
    lean = Vocabulary.__new__(Vocabulary)
    lean.__dict__ |= {k: x for k, x in v.__dict__.items() if k not in ("words", "ids", "counts")}
    shared = docs.sparkSession.sparkContext.broadcast({"v": lean, "w": scoring_weights(model.weights), "hot": pa.array([w for w, _ in hot], pa.binary()), "logs": logs, "tails": tail_of_hot})
    scored = docs.mapInArrow(_scorer(shared), SCORED).withColumn("row_id", F.monotonically_increasing_id())
    scored = materialize(scored, "lm-scored")
    pairs = scored.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_id", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    joined = pairs.join(counts.select("word", "c"), "word")  # words without a count add log(1) and are not known
    rest = joined.groupBy("row_id").agg(F.sum(F.col("times") * F.log(F.col("c") + 1.0)).alias("rare_logs"), F.sum("times").alias("n_rare"))
    out = scored.drop("rare", "times").join(rest, "row_id", "left")
    rare = F.coalesce("rare_logs", F.lit(0.0))
    ln10 = float(np.log(10))
    known_end = 1 if end_count else 0
    base = F.col("logs") + rare + float(np.log(end_count + 1.0)) - F.col("n_tokens") * float(np.log(total + types + 1.0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0)) + known_end).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (base / ln10).alias("base_score"),
        ((F.col("model") + F.col("tail_logs") + rare) / ln10).alias("score"),
    )
