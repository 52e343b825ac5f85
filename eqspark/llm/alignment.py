"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how many documents of the corpus say so.

A text is encoded by a byte-level BPE (A, on a space and the text) and by a piece BPE with byte fallback (B, which adds the space itself). Both cut the same
bytes. Byte offsets where tokens of both end cut them into groups; a link is a pair of an A and a B occurrence whose byte ranges overlap. An id pair's count
is the number of documents that hold it linked.

The count is a cogroup of postings. One pass encodes every document and leaves three kinds of rows in the shared folder: the document's own figures; postings, that is
(A id, B ids, documents, multiplicities) of the documents of a batch, packed as arrays; and the batch's part of each pair's count. Counts and postings are
then shuffled by A id and sorted, so that a task reads the parts of an id's counts first, adds them and finds their maximum (at most one number for each B id), and then streams the postings
past them. It leaves, for each document, the sum over the links it saw; a last shuffle by batch adds these. The sorts spill, and a task holds one batch of each side.

Frequent A ids are dealt over several tasks by batch: postings go to one of them, counts to all. How many follows from the postings of each A id, a
table of at most 65,536 rows, which is broadcast.

Edge cases: texts that are null or empty, or whose joined tokens do not spell a space and the text (B drops or changes some bytes), have no tokens: all figures are 0 and the hash is ''.
Special tokens' strings are plain text. Repeated rows, also with equal or null doc_id, are documents of their own. An empty table gives no rows. Other columns are not read. Texts are encoded
whole; a text of any length is one row of its batch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Ids of both sides fit 16 bits; this is checked.
IDS = 1 << 16
#: A batch ends at so many documents or postings.
BATCH_DOCS, BATCH_LINKS = IDS, 2_000_000
#: Bytes of text that are encoded and aligned together.
CHUNK = 1_500_000
#: Postings of a packed row.
ROW = 2048
#: Sums held by a task before they are given on, in documents.
HELD_DOCS = 2_000_000

DOC, COUNTS, POSTINGS = 0, 1, 2
FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PACKED = f"kind int, batch long, at int, a int, n long, x binary, y binary, z binary, {FIGURES}"
ADDED = f"kind int, batch long, at int, x binary, y binary, z binary, {FIGURES}"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Encoder:
    """Both tokenizers of a worker."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        n = self.b.get_piece_size()
        if max(ranks.values()) >= IDS or n > IDS:
            raise ValueError("token ids must fit 16 bits")
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            a_bytes[rank] = token
        self.a_len = np.array([len(x) for x in a_bytes], np.int64)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # an id's text with each of the marks that may follow it
        self.marked = [f"{i}{mark}" for mark in ",|;" for i in range(IDS)]

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """A and B ids, or None where B's do not spell the text (A's always do: its pattern covers every character, and all bytes are tokens)."""
        if not text:
            return None
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != b" " + text.encode():
            return None
        return self.a.encode_ordinary(" " + text), b


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*key: str) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def align(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of links; the A and B place of each link; the group of each A and B token. The tokens of several documents may follow each other, as both sides end with each document."""
    ends = np.union1d(a_end, b_end)
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    return ends, np.searchsorted(a_end, ends), np.searchsorted(b_end, ends), np.searchsorted(both, a_end), np.searchsorted(both, b_end)


def group_texts(marked: list[str], a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
    """Each token with the mark after it, in the order a1,a2|b1;... of the groups."""
    def marks(group: np.ndarray, last: int) -> np.ndarray:
        ends = np.ones(len(group), bool)
        ends[:-1] = group[1:] != group[:-1]
        return np.where(ends, last, 0)

    codes = np.concatenate([a + IDS * marks(a_group, 1), b + IDS * marks(b_group, 2)])
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    return list(map(marked.__getitem__, codes[order].tolist()))


class Batch:
    """Documents of one batch: their figures, and the links of each as sorted keys (document, A id, B id) with multiplicities."""

    def __init__(self) -> None:
        self.figures: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def add(self, encoder: Encoder, doc_ids: list[int | None], texts: list[str | None]) -> None:
        found = [encoder.encode(t or "") for t in texts]
        whole = [i for i, x in enumerate(found) if x is not None]
        first = len(self.figures)
        rows = [(d, 0, 0, 0, 0, "") for d in doc_ids]
        if whole:
            n_a, n_b = (np.array([len(found[i][side]) for i in whole]) for side in (0, 1))
            a, b = (np.concatenate([np.array(found[i][side], np.int64) for i in whole]) for side in (0, 1))
            a_end, b_end = np.cumsum(encoder.a_len[a]), np.cumsum(encoder.b_len[b])
            last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
            ends, at_a, at_b, a_group, b_group = align(a, b, a_end, b_end)
            texts_of = group_texts(encoder.marked, a, b, a_group, b_group)
            doc_end = a_end[last_a - 1]
            if not np.array_equal(doc_end, b_end[last_b - 1]):
                raise AssertionError("tokens of a document do not end together")
            links_to, groups_to = np.searchsorted(ends, doc_end) + 1, a_group[last_a - 1] + 1
            n_links, n_groups = np.diff(links_to, prepend=0), np.diff(groups_to, prepend=0)
            stop = np.cumsum(n_a + n_b)
            for k, i in enumerate(whole):
                digest = hashlib.sha256("".join(texts_of[stop[k] - n_a[k] - n_b[k] : stop[k]])[:-1].encode()).hexdigest()
                rows[i] = (doc_ids[i], int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), digest)
            doc = np.repeat(np.array(whole) + first, n_links)
            keys, times = np.unique((doc.astype(np.int64) << 32) | (a[at_a] << 16) | b[at_b], return_counts=True)
            self.keys.append(keys)
            self.times.append(times.astype("<u4"))
            self.links += len(keys)
        self.figures += rows

    def rows(self, batch: int) -> Iterator[pa.RecordBatch]:
        n = len(self.figures)
        yield _packed(n, kind=DOC, batch=batch, at=np.arange(n), n=n, figures=self.figures)
        if not self.keys:
            return
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        pair, doc = key & 0xFFFFFFFF, (key >> 32).astype("<u2")
        by = np.argsort(pair, kind="stable")
        pair, doc, times = pair[by], doc[by], times[by]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        yield _blobs(COUNTS, batch, n, pair[first] >> 16, [(pair[first] & 0xFFFF).astype("<u2"), np.diff(first, append=len(pair)).astype("<u4")])
        yield _blobs(POSTINGS, batch, n, pair >> 16, [(pair & 0xFFFF).astype("<u2"), doc, times])


def _packed(rows: int, kind: int, batch: int, n: np.ndarray | int, at: np.ndarray | None = None, a: np.ndarray | None = None, blobs: list[pa.Array] = (), figures: list[tuple] | None = None) -> pa.RecordBatch:
    void = lambda t: pa.nulls(rows, t)
    column = lambda x, t: void(t) if x is None else pa.array(np.broadcast_to(np.asarray(x), rows), t)
    parts = [column(kind, pa.int32()), column(batch, pa.int64()), column(at, pa.int32()), column(a, pa.int32()), column(n, pa.int64())]
    parts += [*blobs, *[void(pa.binary())] * (3 - len(blobs))]
    types = [*[pa.int64()] * 5, pa.string()]
    parts += [void(t) for t in types] if figures is None else [pa.array(x, t) for x, t in zip(zip(*figures, strict=True) if figures else [[]] * 6, types, strict=True)]
    return pa.RecordBatch.from_arrays(parts, [x.split()[0] for x in PACKED.split(", ")])


def _blobs(kind: int, batch: int, docs: int, a: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of at most ``ROW`` entries of one A id; ``a`` is sorted. ``at`` is how many entries a row has."""
    start = np.flatnonzero(np.diff(a, prepend=-1))
    size = np.diff(start, append=len(a))
    pieces = -(-size // ROW)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + ROW * within
    bounds = np.append(start, len(a))
    blobs = [pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((bounds * c.itemsize).astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(c).tobytes())]) for c in columns]
    return _packed(len(start), kind, batch, docs, at=np.diff(bounds), a=a[start], blobs=blobs)


def _encoded(ranks_path: str, pattern: str, pieces_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, pieces_path)
        number, current = TaskContext.get().partitionId() << 32, Batch()
        for rows in batches:
            ids, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            at = 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and size < CHUNK and stop - at < BATCH_DOCS - len(current.figures):
                    size += len(texts[stop] or "")
                    stop += 1
                current.add(encoder, ids[at:stop], texts[at:stop])
                at = stop
                if len(current.figures) >= BATCH_DOCS or current.links >= BATCH_LINKS:
                    yield from current.rows(number)
                    number, current = number + 1, Batch()
        if current.figures:
            yield from current.rows(number)

    return run


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part, kind): an A id's counts are added up, then its postings are read past them. Sums of documents are given on by batch."""
    counts, touched, best, last = np.zeros(IDS, np.int64), [], 0, None
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        out = []
        for batch, (total, at_best) in sums.items():
            docs = np.flatnonzero(total)
            out.append((POSTINGS, batch, len(docs), docs.astype("<u2").tobytes(), total[docs].tobytes(), at_best[docs].tobytes()))
        sums.clear()
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        n = len(out)
        parts = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)]
        parts += [pa.nulls(n, t) for t in [*[pa.int64()] * 5, pa.string()]]
        return pa.RecordBatch.from_arrays(parts, [x.split()[0] for x in ADDED.split(", ")])

    for rows in batches:
        for a, part, kind, batch, n, x, y, z in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (a, part) != last:
                for b in touched:
                    counts[b] = 0
                touched, best, last = [], 0, (a, part)
            b = np.frombuffer(x, "<u2")
            if kind == COUNTS:
                counts[b] += np.frombuffer(y, "<u4")  # the B ids of a row differ
                touched.append(b)
                best = max(best, int(counts[b].max()))
                continue
            if batch not in sums:
                if held + n > HELD_DOCS and sums:
                    yield flush()
                    held = 0
                sums[batch] = np.zeros(n, np.int64), np.zeros(n, np.int64)
                held += n
            doc, times, count = np.frombuffer(y, "<u2"), np.frombuffer(z, "<u4").astype(np.int64), counts[b]
            np.add.at(sums[batch][0], doc, times * count)
            top = count == best
            np.add.at(sums[batch][1], doc[top], times[top])
    yield flush()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (batch, kind from contributions to documents): a batch's sums are added, then its documents get theirs."""
    batch_now, total, at_best = None, np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
    names = [x.split()[0] for x in RESULT.split(", ")]
    for rows in batches:
        kinds, keys, places = rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()
        docs: list[int] = []
        best_of: list[int] = []
        sum_of: list[int] = []
        for i, (kind, batch, at) in enumerate(zip(kinds, keys, places, strict=True)):
            if batch != batch_now:
                batch_now = batch
                total[:], at_best[:] = 0, 0
            if kind == POSTINGS:
                doc = np.frombuffer(rows.column(3)[i].as_py(), "<u2")  # each once in a row
                total[doc] += np.frombuffer(rows.column(4)[i].as_py(), np.int64)
                at_best[doc] += np.frombuffer(rows.column(5)[i].as_py(), np.int64)
            else:
                docs.append(i)
                best_of.append(int(at_best[at]))
                sum_of.append(int(total[at]))
        kept = rows.take(pa.array(docs, pa.int64()))
        own = dict(zip(kept.schema.names, kept.columns, strict=True)) | {"n_best": pa.array(best_of, pa.int64()), "count_sum": pa.array(sum_of, pa.int64())}
        yield pa.RecordBatch.from_arrays([own[x] for x in names], names)


def align_documents(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    encoded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoded(ranks_path, pattern, pieces_path), PACKED)
    packed = materialize(encoded, "alignment")  # encoded once
    postings, counts = packed.where(F.col("kind") == POSTINGS), packed.where(F.col("kind") == COUNTS)
    sizes = materialize(postings.groupBy("a").agg(F.sum("at").alias("size")), "alignment-sizes")  # at most 65,536 rows
    total = sizes.agg(F.sum("size")).first()[0] or 0
    share = max(ROW, total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.broadcast(sizes.select("a", F.ceil(F.col("size") / share).cast("int").alias("parts")))
    dealt = postings.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("batch", F.xxhash64("y")), F.col("parts")).cast("int"))
    shared = counts.join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    wanted = ["a", "part", "kind", "batch", "n", "x", "y", "z"]
    sorted_ = shared.select(*wanted).unionByName(dealt.select(*wanted)).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    added = sorted_.mapInArrow(_contributions, ADDED)
    names = [x.split()[0] for x in ADDED.split(", ")]
    both = added.unionByName(packed.where(F.col("kind") == DOC).select(*names)).repartition("batch").sortWithinPartitions("batch", F.col("kind").desc())
    return both.mapInArrow(_summed, RESULT)
