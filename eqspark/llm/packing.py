"""Sequence packing by Karmarkar-Karp multiway differencing.

Every whole document is tokenized (and ends with ``END_ID``). A document is cut at each full window, which is a sequence by
itself, and what is left over is cut into pieces of at most ``PIECE``. Batches of ``BATCH`` pieces are dealt into
windows by the largest differencing method: partial partitions of k windows merge, the fullest windows of one with
the emptiest of the other, always taking the two with the largest imbalance, so windows end nearly equal. k starts
at the least count that could hold the tokens and rises while any window is above capacity.

A partition's packing needs no other partition, so there is no shuffle, memory is bounded by a batch, and a lost task
gives the same rows again. sequence_id is the partition's number (upper bits) and a running number.

Edge cases: a null or empty text is one piece with the end id alone; very long texts give many full windows;
repeated rows are packed each; a null doc_id is carried as null; an empty table gives no rows; extra columns are
not read. A text that spells a special token of the tokenizer (``<|``...) is encoded in its own case, as the tokenizer looks for these before it
lowers letters.
"""

from __future__ import annotations

import heapq
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: Longest piece of what full windows leave of a document.
PIECE = 512
#: Pieces that are differenced together.
BATCH = 512
END_ID = 1
#: Words whose ids are kept; older ones go in two generations, so memory is bounded.
CACHE_WORDS = 400_000
#: Marks that the tokenizer parts from letters before them.
MARKS = b".,;:!?"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def karmarkar_karp(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of k windows and the window of each item, by multiway differencing. Ties: the earlier item first.

    A merge keeps sums and their order alone; who went where is read back from the tree of merges at the end.
    """
    n = len(sizes)
    if k == 1:
        return np.array([sum(sizes)]), np.zeros(n, np.int64)
    order = count()
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for at, x in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = x
        heap.append((-x, next(order), sums, at))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, node_a = heapq.heappop(heap)
        _, _, b, node_b = heapq.heappop(heap)
        sums = a + b[::-1]  # both are in falling order
        by = np.argsort(-sums, kind="stable")
        sums = sums[by]
        merges.append((node_a, node_b, by))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), next(order), sums, n + len(merges) - 1))
    labels: dict[int, np.ndarray] = {heap[0][3]: np.arange(k)}
    window = np.empty(n, np.int64)
    for node in range(n + len(merges) - 1, n - 1, -1):
        node_a, node_b, by = merges[node - n]
        own = np.empty(k, np.int64)
        own[by] = labels.pop(node)
        labels[node_a], labels[node_b] = own, own[::-1]
    for at in range(n):
        window[at] = labels[at][0]
    return heap[0][2], window


def windows_of(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; sizes are at most that."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        sums, window = karmarkar_karp(sizes, k)
        if sums.max() <= capacity:
            groups: list[list[int]] = [[] for _ in range(k)]
            for at, w in enumerate(window):
                groups[w].append(at)
            return [g for g in groups if g]
        k += 1


class WordIds:
    """Token ids of a text as little-endian bytes. Ids of white-space separated words are kept, as no token spans white space."""

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # words in ASCII and lower case are already as the normalizer leaves them
        self.plain = Tokenizer.from_file(path)
        self.plain.no_padding()
        self.plain.no_truncation()
        self.plain.normalizer = normalizers.Sequence([])
        (self.mark,) = self.plain.encode("|", add_special_tokens=False).ids
        self.keep, self.young, self.old = keep, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_lower(t.encode()).split() for t in texts]  # at ASCII white space only, which no token spans
        get = self.young.get
        found = [list(map(get, words)) for words in split]
        gaps = [[j for j, ids in enumerate(row) if ids is None] if None in row else () for row in found]
        self._learn({words[j] for words, at in zip(split, gaps, strict=True) for j in at})
        held = self.young
        for words, row, at in zip(split, found, gaps, strict=True):
            for j in at:
                row[j] = held[words[j]]
        out = list(map(b"".join, found))
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Put ``words`` into the young generation. A word with marks at its end is its stem and the marks, which are tokens apart."""
        young, old = self.young, self.old
        fresh: dict[bytes, None] = {}
        joined = []
        for w in words:
            if (ids := old.get(w)) is not None:
                young[w] = ids
                continue
            stem = w.rstrip(MARKS)
            if stem and stem != w and (stem[-1:].isalnum() or (stem[-1] > 127 and stem.decode()[-1:].isalpha())):
                marks = w[len(stem) :]
                joined.append((w, stem, marks))
                for x in (stem, marks):
                    if x not in young:
                        if (ids := old.get(x)) is not None:
                            young[x] = ids
                        else:
                            fresh[x] = None
            else:
                fresh[w] = None
        simple, other = [], []
        for w in fresh:
            (simple if min(w) > 32 and max(w) < 124 and w == w.lower() else other).append(w)
        # plain words go in one text with a mark between them that is a token by itself and that none of them holds ("|" is 124)
        for start in range(0, len(simple), 4096):
            part = simple[start : start + 4096]
            ids = np.array(self.plain.encode_batch_fast([" | ".join([w.decode() for w in part])], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark)).tolist()
            at = 0
            for w, end in zip(part, [*ends, len(data)], strict=True):
                young[w] = data[at:end]
                at = end + 4
        for start in range(0, len(other), 4096):
            part = other[start : start + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                young[w] = _bytes_of(e.ids)
        for w, stem, marks in joined:
            young[w] = young[stem] + young[marks]


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _lower(text: bytes) -> bytes:
    """A-Z to lower case, as the tokenizer does itself, but for texts that may spell its special tokens."""
    return text if b"<|" in text else text.lower()


_WORD_IDS: dict[str, WordIds] = {}


def shared_word_ids(path: str) -> WordIds:
    """The worker process's cache. A function of the module is sent by name, so it finds the module's own dictionary in every task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def packer(tokenizer_path: str, window: int, piece: int, batch: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared_word_ids(tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        numbers = count(first)
        waiting: list[tuple] = []
        rows: list[tuple] = []

        def deal(pieces: list[tuple]) -> None:
            for group in windows_of([p[2] for p in pieces], window):
                number, at = next(numbers), 0
                for i in group:
                    rows.append((*pieces[i], number, at))
                    at += pieces[i][2]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)
            rows.clear()
            return out

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start in range(0, len(texts), 256):
                for doc_id, data in zip(doc_ids[start : start + 256], ids_of.encode([t or "" for t in texts[start : start + 256]]), strict=True):
                    data += end
                    n, at = len(data) // 4, 0
                    while at < n:
                        left = n - at
                        length = window if left >= window else min(left, piece)
                        crc = zlib.crc32(data[4 * at : 4 * (at + length)])
                        if length == window:
                            rows.append((doc_id, at, length, crc, n, next(numbers), 0))
                        else:
                            waiting.append((doc_id, at, length, crc, n))
                        at += length
                while len(waiting) >= batch:
                    deal(waiting[:batch])
                    del waiting[:batch]
            if rows:
                yield flush()
        deal(waiting)
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, piece: int = PIECE, batch: int = BATCH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packer(tokenizer_path, window, piece, batch, end_id), SCHEMA)
