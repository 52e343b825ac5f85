"""Exact top-k search by integer inner product with multi-resolution segment statistics.

Vectors become floor(SCALE * x). For a segment of n components with means p, q and deviations s, t, the inner product
is at most n * (p * q + s * t), that is, the squared distance is at least n * ((p - q)^2 + (s - t)^2). Bounds are taken
coarse to fine (1, 4, then 16 segments for 64 components); only candidates whose bound reaches the k-th exact score
found so far go on, and survivors get exact scores. Ties go to the smaller vec_id, so a bound equal to the k-th
score goes on too.

Queries are the rows whose vec_id is divisible by ``QUERY_STEP``. Both sides are cut into blocks (``QUERY_BLOCK`` and
``CANDIDATE_BLOCK`` vectors). The search has two passes. In the first, every query meets some ``SCOUT_BLOCKS`` candidate blocks; the k-th best score of
these, or of any candidates, is at most the k-th best of all, so it is a threshold that holds everywhere. In the second, every query block meets every candidate block:
a block whose envelope of coarse means and deviations stays below the thresholds is left as a whole, and a meeting gives only rows that reach the
threshold, which are merged by rank. Blocks are dealt into groups of both sides in proportion to their numbers, so a task is
at most ``QUERY_GROUP`` by ``CANDIDATE_GROUP`` blocks at every size of the tables. Memory of a task: one block of each.

Scores are exact integers: in doubles while all sums stay below 2^53, in 64-bit integers while they stay below 2^63, and in unbounded integers
beyond. A score that a long cannot hold is reported, and ranked, as the nearest long.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; nor do rows with a null
vec_id; vectors meet those of their own length alone; fewer than
k candidates give them all; repeated vec_ids are separate rows, a query skips every row of its own id; empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
TOP = 10
QUERY_STEP = 100
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
#: Candidate blocks of the first pass, and their bytes at most; they are broadcast.
SCOUT_BLOCKS, SCOUT_BYTES = 4, 16_000_000
#: Blocks of a task, and groups of candidates at least (so that small tables are spread, too).
QUERY_GROUP, CANDIDATE_GROUP, GROUPS = 64, 16, 32
SCHEMA = "query_id long, vec_id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1
#: Components up to this are whole in a double after scaling.
PLAIN = 2.0**42


def resolutions(dim: int) -> list[int]:
    """Segment counts, coarse to fine; each divides ``dim``."""
    return [s for s in (1, 4, 16) if dim % s == 0 and s < dim]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled by the root of its length: bounds are then plain inner products."""
    parts = x.reshape(len(x), segments, x.shape[1] // segments)
    root = np.sqrt(parts.shape[2])
    return np.concatenate([parts.mean(axis=2) * root, parts.std(axis=2) * root], axis=1)


class Block:
    """Vectors of one length as whole doubles with their statistics; those too large for that are kept as lists of integers."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        fits = (np.abs(raw) <= PLAIN).all(axis=1)
        self.ids, self.x = ids[fits], np.floor(SCALE * raw[fits])
        self.large = [(int(i), [_scaled(c) for c in v]) for i, v in zip(ids[~fits], raw[~fits].tolist(), strict=True)]
        self.all_ids, self.raw = ids, raw
        self.top = float(np.abs(self.x).max()) if len(self.x) else 0.0
        self.levels = [statistics(self.x, s) for s in resolutions(raw.shape[1])]

    def integers(self) -> list[tuple[int, list[int]]]:
        return [(int(i), [_scaled(c) for c in v]) for i, v in zip(self.all_ids, self.raw.tolist(), strict=True)]


def _scaled(c: float) -> int:
    """floor(SCALE * c) without overflow: a component beyond ``PLAIN`` has no digits after the point that a double keeps at this scale."""
    return int(np.floor(SCALE * c)) if abs(c) <= PLAIN else _floor_times(c)


def _floor_times(c: float) -> int:
    top, bottom = c.as_integer_ratio()
    return SCALE * top // bottom


def _held(score: int) -> int:
    return min(MOST, max(LEAST, score))


def exact(x: np.ndarray, q: np.ndarray, top_x: float, top_q: float) -> np.ndarray:
    """Inner products of rows of whole doubles, as 64-bit integers held to their range."""
    bound = len(q) * top_x * top_q
    if bound < 2.0**53:
        return (x @ q).astype(np.int64)
    if bound < 2.0**63:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(c) for c in q]
    return np.array([_held(sum(int(a) * b for a, b in zip(row, whole, strict=True))) for row in x], np.int64)


def search_block(q: Block, c: Block, k: int, thresholds: dict[int, int]) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best of this block for each query, as far as they reach the query's threshold."""
    out: list[tuple[int, int, int]] = []
    coarse = _coarse(q, c) if q.levels and len(q.x) and len(c.x) else None
    for i, q_id in enumerate(q.ids.tolist()):
        least = thresholds.get(q_id, LEAST)
        slack = 1e-6 * (1 + np.abs(q.x[i]).sum() * c.top)  # of the bounds' rounding
        found = []
        if len(c.x) and (coarse is None or coarse[i] >= least - slack):
            found = _search(q, i, c, k, least, slack)
        if c.large:
            whole = [int(v) for v in q.x[i]]
            found = _best(found + [(_held(sum(a * b for a, b in zip(v, whole, strict=True))), j) for j, v in c.large if j != q_id], k)
        out += [(q_id, j, s) for s, j in found if s >= least]
    if q.large:
        whole = c.integers()
        for q_id, v in q.large:
            found = _best([(_held(sum(a * b for a, b in zip(v, w, strict=True))), j) for j, w in whole if j != q_id], k)
            out += [(q_id, j, s) for s, j in found if s >= thresholds.get(q_id, LEAST)]
    return out


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def _coarse(q: Block, c: Block) -> np.ndarray:
    """The most that any candidate of the block can score with each query: bounds by the block's least and greatest coarse means and deviations."""
    low, high = c.levels[0].min(axis=0), c.levels[0].max(axis=0)
    return np.maximum(q.levels[0] * low, q.levels[0] * high).sum(axis=1)


def _search(q: Block, i: int, c: Block, k: int, least: int, slack: float) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best plain candidates for one plain query."""
    own, top = q.x[i], float(np.abs(q.x[i]).max())
    at = np.flatnonzero(c.ids != q.ids[i])
    for depth, (lq, lx) in enumerate(zip(q.levels, c.levels, strict=True)):
        bound = lx[at] @ lq[i] if depth else lx @ lq[i]
        if not depth:
            bound = bound[at]
        if len(at) > 4 * k and depth in (0, len(q.levels) - 1):
            # the k-th score among the likeliest is a threshold, too
            likely = at[np.argpartition(-bound, 4 * k - 1)[: 4 * k]]
            least = max(least, int(np.partition(exact(c.x[likely], own, c.top, top), len(likely) - k)[len(likely) - k]))
        at = at[bound >= least - slack]
    scores = exact(c.x[at], own, c.top, top)
    if len(at) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at, scores = at[scores >= edge], scores[scores >= edge]
    order = np.lexsort((c.ids[at], ~scores))[:k]  # ~ falls as scores rise, without overflow
    return [(int(scores[j]), int(c.ids[at[j]])) for j in order]


def _blocks(side: str, rows: int, with_least: bool = False):
    """Rows (ids, vectors as float64 bytes, dim, and thresholds if asked) of at most ``rows`` vectors of one length, from whatever a partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, list[int]] = {}
        vectors: dict[int, list[np.ndarray]] = {}
        least: dict[int, list[int]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            data = [np.array(ids.pop(dim), np.int64).tobytes(), np.stack(vectors.pop(dim)).tobytes(), dim, np.array(least.pop(dim), np.int64).tobytes()]
            kinds, names = (pa.binary(), pa.binary(), pa.int32(), pa.binary()), (f"{side}_ids", f"{side}_data", "dim", "least")
            n = 4 if with_least else 3
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(data[:n], kinds[:n], strict=True)], list(names[:n]))

        for b in batches:
            thresholds = b.column(2).to_pylist() if with_least else [None] * b.num_rows
            for vec_id, v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), thresholds, strict=True):
                dim = len(v)
                ids.setdefault(dim, []).append(vec_id)
                vectors.setdefault(dim, []).append(np.array(v, np.float64))
                least.setdefault(dim, []).append(LEAST if t is None else t)
                if len(ids[dim]) >= rows:
                    yield flush(dim)
        for dim in list(ids):
            yield flush(dim)

    return run


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[bytes, Block]] = {}

        def block(side: str, ids: bytes, data: bytes, dim: int) -> Block:
            if side not in last or last[side][0] != data:
                last[side] = data, Block(np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim))
            return last[side][1]

        for b in batches:
            for q_ids, q_data, least, c_ids, c_data, dim in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q, c = block("q", q_ids, q_data, dim), block("c", c_ids, c_data, dim)
                thresholds = dict(zip(np.frombuffer(q_ids, np.int64).tolist(), np.frombuffer(least, np.int64).tolist(), strict=True)) if least else {}
                found = search_block(q, c, k, thresholds)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], []))], ["query_id", "vec_id", "score"])

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, k: int = TOP, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of every query."""
    rows = usable(embeddings)
    is_query = F.col("vec_id") % query_step == 0
    n, n_queries, dim = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("v"))).first()
    # few queries in many files would make many small blocks, so their number of partitions is fitted to their count
    parts = max(1, -(-n_queries // QUERY_BLOCK))
    make_q = _blocks("q", QUERY_BLOCK)
    queries = rows.where(is_query)
    q = queries.repartition(parts).mapInArrow(make_q, "q_ids binary, q_data binary, dim int")
    # first pass: some rows (any will do, and their bytes are bounded) against all queries give each query's threshold
    scouts = min(SCOUT_BLOCKS * CANDIDATE_BLOCK, SCOUT_BYTES // (8 * (dim or 1)))
    few = rows.where(F.rand(7) < scouts / max(n, 1)).limit(2 * scouts).coalesce(1)
    few = few.mapInArrow(_blocks("c", CANDIDATE_BLOCK), "c_ids binary, c_data binary, dim int")
    empty = F.lit(None).cast("binary").alias("least")
    met = q.join(F.broadcast(few), "dim").select("q_ids", "q_data", empty, "c_ids", "c_data", "dim")  # at most 2 * SCOUT_BYTES
    least = _ranked(met.mapInArrow(_searcher(k), SCHEMA), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    # second pass: blocks against blocks, a stated query set against all rows
    armed = queries.join(least, "vec_id", "left").repartition(parts).mapInArrow(_blocks("q", QUERY_BLOCK, True), "q_ids binary, q_data binary, dim int, least binary")
    c = rows.mapInArrow(_blocks("c", CANDIDATE_BLOCK), "c_ids binary, c_data binary, dim int")
    n_blocks = -(-n // CANDIDATE_BLOCK)
    c_groups, q_groups = max(1, min(n_blocks, max(GROUPS, -(-n_blocks // CANDIDATE_GROUP)))), max(1, -(-parts // QUERY_GROUP))
    group = lambda ids, groups: F.pmod(F.xxhash64(ids), F.lit(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    c = c.withColumn("c_group", group("c_ids", c_groups)).withColumn("q_group", every(q_groups))
    armed = armed.withColumn("q_group", group("q_ids", q_groups)).withColumn("c_group", every(c_groups))
    met = c.join(armed.hint("merge"), ["dim", "c_group", "q_group"]).select("q_ids", "q_data", "least", "c_ids", "c_data", "dim")
    return _ranked(met.mapInArrow(_searcher(k), SCHEMA), k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
