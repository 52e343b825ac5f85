"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input joins the embedding of its form (lower case, without outer punctuation), the mean embedding of its character
trigrams and the embeddings of its beginnings; the tables start from how strongly each sets toxic training texts apart, and are trained on. Windows
of ``WINDOW`` words, a new one every ``STRIDE`` words, cover the whole text; each window's states are pooled by attention
and give a probability, and a document's score is its windows' largest.

Labels are learned from a bounded sample: at most ``TRAIN_ROWS`` labelled documents, those with the smallest id hashes, and never those
with crc32(doc_id) mod 5 = 0; ``TRAIN_CHARS`` bounds their texts, and of rows that share a doc_id one is learned from. A toxic text teaches by its most suspicious window, another by its most suspicious ones and
one at random.

Edge cases: a null or empty text scores ``EMPTY_SCORE``, as do all texts if no label or only one class can be learned;
repeated rows are scored each; a doc_id with several labels counts as each of them; null labels are not learned from; a null doc_id is
scored; an empty table gives no rows; extra columns pass through in ``keep_civil`` and are not read elsewhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import labelled

HELD_OUT_MOD, HELD_OUT_REST = 5, 0
TRAIN_ROWS = 4000
#: Characters learned from, in all; no text of over a fortieth of that.
TRAIN_CHARS = 40_000_000
THRESHOLD = 0.5
EMPTY_SCORE = 0.01
WINDOW, STRIDE = 64, 48
HIDDEN, ATTENTION = 10, 8
WORD_DIM, CHAR_DIM, HEAD_DIM = 5, 5, 4
DIM = WORD_DIM + CHAR_DIM + HEAD_DIM
MAX_WORDS = 20_000
TRIGRAMS = 4096
#: Lengths (bytes) of beginnings that have embeddings, and their hash places.
HEADS, HEAD_PLACES = (4, 6), 16384
MIN_TEXTS = 4
WORD_DROP = 0.3
EPOCHS = 4
BATCH = 64
CHUNK_WORDS = 100_000
EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_~`"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))


def split(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of ``^word$`` laid end to end, and where each word's begin."""
    data = np.frombuffer(b"".join(b"\x02" + (w.strip(EDGE) or w) + b"\x03" for w in words) + b"\x00\x00", np.uint8).astype(np.int64)
    code = (data[:-2] * 31 + data[1:-1]) * 131 + data[2:]
    code = (code * 2654435761 >> 7) % TRIGRAMS
    begin = np.flatnonzero(data[:-2] == 2)
    inner = (data[:-2] != 3) & (data[1:-1] != 3)  # those that start within the word
    inner[begin] = True
    return code[inner], np.searchsorted(np.flatnonzero(inner), begin)


def heads(words: list[bytes]) -> np.ndarray:
    """Hash places (n, lengths) of each word's beginnings; 0 where the word is shorter."""
    forms = [w.strip(EDGE) for w in words]
    out = np.zeros((len(words), len(HEADS)), np.int32)
    for j, k in enumerate(HEADS):
        out[:, j] = [zlib.crc32(f[:k]) % (HEAD_PLACES - 1) + 1 if len(f) >= k else 0 for f in forms]
    return out


class Encoder:
    """Vocabulary of the training texts and the first embeddings."""

    def __init__(self, texts: list[list[bytes]], labels: np.ndarray):
        docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
        grams = {0: np.zeros(TRIGRAMS), 1: np.zeros(TRIGRAMS)}
        begun = {0: np.zeros(HEAD_PLACES), 1: np.zeros(HEAD_PLACES)}
        for words, y in zip(texts, labels, strict=True):
            forms = {w.strip(EDGE) for w in words} - {b""}
            docs[int(y)].update(forms)
            if forms:
                grams[int(y)][np.unique(trigrams(list(forms))[0])] += 1
                begun[int(y)][np.unique(heads(list(forms)))] += 1
        n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        total = docs[0] + docs[1]
        self.words = [w for w, c in sorted(total.items(), key=lambda x: (-x[1], x[0])) if c >= MIN_TEXTS][:MAX_WORDS]
        self.ids = {w: i + 1 for i, w in enumerate(self.words)}
        lift = lambda a, b: _shrink(a, b, n1, n0)
        self.word_start = np.array([0.0, *(lift(docs[1][w], docs[0][w]) for w in self.words)], np.float32)
        self.head_start = np.array([0.0, *(lift(a, b) for a, b in zip(begun[1][1:], begun[0][1:], strict=True))], np.float32)
        self.gram_start = np.array([lift(a, b) for a, b in zip(grams[1], grams[0], strict=True)], np.float32)

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.array([get(w.strip(EDGE), 0) for w in words], np.int32)


def _shrink(a: float, b: float, n1: int, n0: int) -> float:
    """How many deviations beyond 3 the share of toxic texts with a form is from that of others, on a small scale."""
    if a + b < 3:
        return 0.0
    p = (a + b + 1) / (n1 + n0 + 2)
    z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return float(np.sign(z) * min(4.0, max(0.0, abs(z) - 3) / 2))


def window_starts(n: int) -> list[int]:
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def initial(e: Encoder, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    p = {"ew": w(len(e.words) + 1, WORD_DIM, s=0.02), "ec": w(TRIGRAMS, CHAR_DIM, s=0.02), "eh": w(HEAD_PLACES, HEAD_DIM, s=0.02), "va": w(ATTENTION, s=0.3), "wa": w(2 * HIDDEN, ATTENTION, s=0.3), "wo": w(2 * HIDDEN, s=0.3), "bo": np.array([-2.0], np.float32)}
    p["ew"][:, 0] += e.word_start
    p["ec"][:, 0] += e.gram_start
    p["eh"][:, 0] += e.head_start
    p["eh"][0] = 0
    for d in ("f", "r"):
        p |= {f"wx{d}": w(DIM, 3 * HIDDEN, s=0.4), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": w(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5)}
    return p


def word_inputs(words: list[bytes], ids: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Inputs (n, dim) of distinct words, in blocks that bound memory."""
    out = np.empty((len(words), DIM), np.float32)
    out[:, :WORD_DIM] = p["ew"][ids]
    for at in range(0, len(words), 20_000):
        codes, starts = trigrams(words[at : at + 20_000])
        sums = np.add.reduceat(p["ec"][codes], starts, axis=0)
        out[at : at + 20_000, WORD_DIM : WORD_DIM + CHAR_DIM] = sums / np.diff(np.append(starts, len(codes)))[:, None]
        out[at : at + 20_000, WORD_DIM + CHAR_DIM :] = p["eh"][heads(words[at : at + 20_000])].sum(axis=1)
    return out


def _pool(h: np.ndarray, mask: np.ndarray, p: dict[str, np.ndarray]):
    """Attention over steps: h (T, B, 2H), mask (T, B)."""
    a = np.tanh(h @ p["wa"])
    s = np.where(mask, a @ p["va"], -1e9)
    s = np.exp(s - s.max(axis=0))
    s /= s.sum(axis=0)
    return a, s, np.einsum("tb,tbh->bh", s, h)


def train(texts: list[list[bytes]], labels: np.ndarray, seed: int = 3) -> tuple[Encoder, dict[str, np.ndarray]]:
    e = Encoder(texts, labels)
    p = initial(e)
    rng = np.random.default_rng(seed)
    adam = gru.Adam(p, 0.01, decay=1e-3)
    ids = [e.ids_of(t) for t in texts]
    usable = [i for i, t in enumerate(texts) if t]
    for epoch in range(EPOCHS):
        if epoch in (0, 2):
            suspicion = [_suspicion(texts[i], ids[i], e, p, epoch) for i in usable]
        jobs = []
        for i, s in zip(usable, suspicion, strict=True):
            starts = window_starts(len(texts[i]))
            if labels[i]:
                jobs += [(i, starts[int(np.argmax(s))], 1.0)] * 2
            else:
                jobs += [(i, starts[j], 0.0) for j in {int(np.argmax(s)), int(rng.integers(len(starts)))}]
        order = rng.permutation(len(jobs))
        for at in range(0, len(order), BATCH):
            adam.rate = 0.01 * (1 - 0.8 * epoch / EPOCHS)
            _train_batch([jobs[j] for j in order[at : at + BATCH]], texts, ids, p, adam, rng)
    return e, p


def _suspicion(words: list[bytes], ids: np.ndarray, e: Encoder, p: dict[str, np.ndarray], epoch: int) -> np.ndarray:
    starts = window_starts(len(words))
    if len(starts) == 1:
        return np.zeros(1)
    if epoch:
        return score_texts([words], e, p, windows=True)
    lift = np.concatenate([[0], np.cumsum(np.maximum(e.word_start[ids], 0) + np.maximum(e.head_start[heads(words)], 0).sum(axis=1))])
    return np.array([lift[min(s + WINDOW, len(words))] - lift[s] for s in starts])


def _train_batch(jobs: list[tuple[int, int, float]], texts, ids, p, adam: gru.Adam, rng: np.random.Generator) -> None:
    n = len(jobs)
    words: list[bytes] = []
    word_ids: list[int] = []
    index = np.zeros((WINDOW, n), np.int64)
    lengths = np.zeros(n, np.int64)
    for b, (i, start, _) in enumerate(jobs):
        part = texts[i][start : start + WINDOW]
        index[: len(part), b] = np.arange(len(words), len(words) + len(part))
        lengths[b] = len(part)
        words += part
        word_ids += ids[i][start : start + WINDOW].tolist()
    word_ids_a = np.where(rng.random(len(word_ids)) < WORD_DROP, 0, word_ids)  # so that characters count too
    head_ids = heads(words)
    codes, starts = trigrams(words)
    sizes = np.diff(np.append(starts, len(codes)))
    x = np.concatenate([p["ew"][word_ids_a], np.add.reduceat(p["ec"][codes], starts, axis=0) / sizes[:, None], p["eh"][head_ids].sum(axis=1)], axis=1)
    mask = np.arange(WINDOW)[:, None] < lengths
    back = np.where(mask, lengths - 1 - np.arange(WINDOW)[:, None], np.arange(WINDOW)[:, None])  # its own inverse
    lanes = np.arange(n)
    xf, xr = x[index], x[index[back, lanes]]
    zero = np.zeros((n, HIDDEN), np.float32)
    hf, cf = gru.forward(xf @ p["wxf"] + p["bf"], zero, p["uf"])
    hr, cr = gru.forward(xr @ p["wxr"] + p["br"], zero, p["ur"])
    h = np.concatenate([hf, hr[back, lanes]], axis=2)
    a, s, c = _pool(h, mask, p)
    y = np.array([j[2] for j in jobs], np.float32)
    d = ((1 / (1 + np.exp(-(c @ p["wo"] + p["bo"]))) - y) * np.where(y > 0, 2.0, 1.0) / n).astype(np.float32)
    g = {"wo": c.T @ d, "bo": np.array([d.sum()], np.float32)}
    dc = d[:, None] * p["wo"]
    ds = np.einsum("bh,tbh->tb", dc, h)
    ds = s * (ds - (s * ds).sum(axis=0))
    g["va"] = np.einsum("tb,tba->a", ds, a)
    da = ds[:, :, None] * p["va"] * (1 - a * a)
    g["wa"] = np.einsum("tbh,tba->ha", h, da)
    dh = s[:, :, None] * dc + da @ p["wa"].T
    dx = np.zeros_like(x)
    for side, dhs, cache, xs in (("f", dh[:, :, :HIDDEN], cf, xf), ("r", dh[:, :, HIDDEN:][back, lanes], cr, xr)):
        dxg, g[f"u{side}"] = gru.backward(np.ascontiguousarray(dhs), cache, p[f"u{side}"])
        dxg = dxg * (mask[:, :, None])
        g[f"wx{side}"] = np.einsum("tbi,tbj->ij", xs, dxg)
        g[f"b{side}"] = dxg.sum(axis=(0, 1))
        back_dx = dxg @ p[f"wx{side}"].T
        at = index if side == "f" else index[back, lanes]
        np.add.at(dx, at[mask], back_dx[mask])
    g["ew"] = np.zeros_like(p["ew"])
    np.add.at(g["ew"], word_ids_a, dx[:, :WORD_DIM])
    g["ec"] = np.zeros_like(p["ec"])
    np.add.at(g["ec"], codes, np.repeat(dx[:, WORD_DIM : WORD_DIM + CHAR_DIM] / sizes[:, None], sizes, axis=0))
    g["eh"] = np.zeros_like(p["eh"])
    for j in range(len(HEADS)):
        np.add.at(g["eh"], head_ids[:, j], dx[:, WORD_DIM + CHAR_DIM :])
    g["eh"][0] = 0
    adam.update(g)


def lean(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {k: p[k].astype(np.float32) for k in ("ew", "ec", "eh", "va", "wa", "wo", "bo")}
    for d in ("f", "r"):
        out |= {f"wx{d}": gru.halved(p[f"wx{d}"]), f"b{d}": gru.halved(p[f"b{d}"]), f"u{d}": gru.halved(p[f"u{d}"])}
    return out


def score_texts(texts: list[list[bytes]], e, p: dict[str, np.ndarray], windows: bool = False, leaned: bool = False) -> np.ndarray:
    """Score of each text, the largest of its windows' (or all windows' scores, in order)."""
    q = p if leaned else lean(p)
    place: dict[bytes, int] = {}
    enter = place.setdefault
    flat = np.array([enter(w, len(place)) for words in texts for w in words], np.int64)
    words = list(place)
    inputs = word_inputs(words, e.ids_of(words), q) if words else np.zeros((0, DIM), np.float32)
    sides = {d: inputs @ q[f"wx{d}"] + q[f"b{d}"] for d in ("f", "r")}
    begin, length, owner, at = [], [], [], 0
    for i, t in enumerate(texts):
        if t:
            starts = window_starts(len(t))
            begin += [at + s for s in starts]
            length += [min(WINDOW, len(t))] * len(starts)
            owner += [i] * len(starts)
            at += len(t)
    scores = np.empty(len(begin))
    begin, length, owner = np.array(begin, np.int64), np.array(length, np.int64), np.array(owner, np.int64)
    order = np.argsort(-length, kind="stable")
    for block in np.array_split(order, max(1, -(-len(order) // 2048))):
        scores[block] = _score_windows(flat, begin[block], length[block], sides, q)
    if windows:
        return scores
    out = np.full(len(texts), EMPTY_SCORE)
    if len(scores):
        held = np.zeros(len(texts))
        np.maximum.at(held, owner, scores)
        seen = np.unique(owner)
        out[seen] = held[seen]
    return out


def _score_windows(flat, begin, length, sides, q) -> np.ndarray:
    """``length`` falls, so the windows that go on at a step are the first ones."""
    n = len(begin)
    if not n:
        return np.zeros(0)
    steps = int(length[0])
    h = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    f = np.zeros((n, HIDDEN), np.float32)
    r = np.zeros((n, HIDDEN), np.float32)
    live = [int(np.searchsorted(-length, -t)) for t in range(steps)]
    for t in range(steps):
        k = live[t]
        f = gru.step(sides["f"][flat[begin[:k] + t]], f[:k], q["uf"])
        h[t, :k, :HIDDEN] = f
    r = np.zeros((0, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        if k > len(r):
            r = np.concatenate([r, np.zeros((k - len(r), HIDDEN), np.float32)])
        r = gru.step(sides["r"][flat[begin[:k] + t]], r, q["ur"])
        h[t, :k, HIDDEN:] = r
    mask = np.arange(steps)[:, None] < length
    _, _, c = _pool(h, mask, q)
    return 1 / (1 + np.exp(-(c @ q["wo"] + q["bo"]).astype(np.float64)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[list[bytes]], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents that are not held out, ``TRAIN_CHARS`` characters in all."""
    few = labelled(labels, "toxic", held_out(F.col("doc_id")), "toxic", rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.char_length("text") <= TRAIN_CHARS // 40)
    found = own.join(F.broadcast(few), "doc_id").groupBy("h", "y", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))
    texts, ys, chars = [], [], 0
    for row in found.select("h", "y", "x.text").sort("h", "y").toLocalIterator():
        chars += len(row["text"])
        if chars > TRAIN_CHARS:
            break
        texts.append(split(row["text"]))
        ys.append(row["y"])
    return texts, np.array(ys, np.int64)


class _Ids:
    """What scoring needs of an encoder."""

    def __init__(self, e: Encoder):
        self.ids = e.ids

    ids_of = Encoder.ids_of


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, q = shared.value
        for b in batches:
            ids, texts, start, size = b.column(0), b.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "") // 5 + 1
                if size >= CHUNK_WORDS or i == len(texts) - 1:
                    part = [split(t) for t in texts[start : i + 1]]
                    scores = score_texts(part, e, q, leaned=True) if e is not None else np.full(len(part), EMPTY_SCORE)
                    yield pa.RecordBatch.from_arrays([ids.slice(start, i + 1 - start), pa.array(scores)], ["doc_id", "score"])
                    start, size = i + 1, 0

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """(encoder, weights) for scoring, or (None, None) if the labels do not hold both classes."""
    texts, y = sample(docs, labels, rows)
    if len(set(y.tolist())) < 2:
        return None, None
    e, p = train(texts, y)
    return _Ids(e), lean(p)


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keeper(shared):
    """Batches whose last column is the text: their rows that are not predicted toxic, without that column."""
    score = _scorer(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pairs = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(b.num_columns - 1)], ["doc_id", "text"])
            scores = np.concatenate([x.column(1).to_numpy() for x in score(iter([pairs]))])
            yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1])).filter(pa.array(scores < THRESHOLD))

    return run


def keep_civil(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns. Each row goes or stays by its own text, whatever its doc_id.

    Rows pass through the workers, which let those go on that may stay: nothing is joined, shuffled or written.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    plain_names = docs.select(*own)
    kept = docs.select(*own, F.col("text").cast("string").alias("t")).mapInArrow(_keeper(shared), plain_names.schema)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
