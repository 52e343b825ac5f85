"""SimHash near-duplicate classes by multi-index hashing.

Fingerprints: lower-cased (A-Z) words, 3-word shingles with repeats, XXH64 (seed 42) of each, and a bit is 1 where
over half of the hashes have it. Search among the distinct fingerprints, which bounds copies: each is cut into two
32-bit segments, and one table per segment is addressed by that segment. Two fingerprints within 2 bits have a
segment within 1 bit, so a probe enumerates the 33 segment values within 1 bit, fetches what the table holds there
and verifies the complete distance.

A table address with more than ``FULL_BUCKET`` fingerprints would give pairs with the square of its size. Such an
address has a nested table on the other segment: its members meet at common neighbours there (33 places each, at
most 33 members a place, one link to the smallest each), and probes from outside look up the 33 values around their
own other segment. Both are exact, so no link is lost and none is capped.

Components: min-label propagation with large-star and small-star steps over tables in the shared folder.

Edge cases: a null or empty text has fingerprint zero and is linked like any other; repeated doc_ids and rows with
a null doc_id take part in links (a null id never becomes a class id unless all ids of the class are null); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

MAX_BITS = 2
SEED = 42
FULL_BUCKET = 64
#: Fingerprints with more documents than this meet their class apart from the rest, so that no task gets all copies.
MANY_COPIES = 256
#: Rows of a broadcast side of two longs (some 60 bytes each as a hashed table).
KEY_ROWS = 400_000
LOW = 0xFFFFFFFF


def fingerprint_texts(texts: list[str | None]) -> np.ndarray:
    """uint64 fingerprints of whole texts."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for at, text in enumerate(texts):
        words = text.encode().lower().split() if text else ()
        if not words:
            continue
        if len(words) < 3:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]  # noqa: B905
        ones = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 1 << 16):  # 4 MB of bits at most
            block = np.array(hashes[start : start + (1 << 16)], ">u8")
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[at] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprint_texts(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the unsigned fingerprint's bits as a long)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _segment(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if which else fp.bitwiseAND(F.lit(LOW))


def _ball() -> Column:
    """The masks within one bit of a 32-bit segment, with zero first."""
    return F.array(*[F.lit(m).cast("long") for m in [0, *[1 << k for k in range(32)]]])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a < b) that connect all distinct fingerprints within ``MAX_BITS`` bits: every pair outside full buckets, enough to connect within them."""
    fp = F.col("fp")
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(fp, s).alias("key"), _segment(fp, 1 - s).alias("rest")) for s in (0, 1)]))
    index = distinct.select("fp", both.alias("x")).select("fp", "x.*")
    full = materialize(index.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL_BUCKET).select("seg", "key"), "simhash-full")
    probes = index.select("fp", "seg", "rest", "key", F.explode(_ball()).alias("mask")).select(F.col("fp").alias("p_fp"), "seg", F.col("rest").alias("p_rest"), F.col("key").bitwiseXOR(F.col("mask")).alias("key"), (F.col("mask") != 0).alias("moved"))
    close = F.bit_count(F.col("p_fp").bitwiseXOR(fp)) <= MAX_BITS
    ordered = lambda df: df.select(F.least("p_fp", "fp").alias("a"), F.greatest("p_fp", "fp").alias("b"))
    # 1. ordinary buckets: fetch and verify. Sizes are estimated before rows are enlarged, so these joins must not be broadcast
    plain = index.join(full, ["seg", "key"], "left_anti")
    found = ordered(probes.join(plain.hint("merge"), ["seg", "key"]).where(close & (F.col("p_fp") != fp)))
    # 2. within a full bucket: members meet at a neighbour of the other segment
    inside = index.join(full, ["seg", "key"])
    at = inside.select("fp", "seg", "key", "rest", F.explode(_ball()).alias("mask")).select("fp", "seg", "key", F.col("rest").bitwiseXOR(F.col("mask")).alias("place"))
    least = at.groupBy("seg", "key", "place").agg(F.min("fp").alias("p_fp"), F.collect_list("fp").alias("fps"))  # 33 members at most
    within = ordered(least.where(F.size("fps") > 1).select("p_fp", F.explode("fps").alias("fp")).where(close & (F.col("p_fp") != fp)))
    # 3. from beside a full bucket, at one bit: one bit is left for the other segment
    beside = probes.where("moved").join(full, ["seg", "key"]).select("p_fp", "seg", "key", F.explode(_ball()).alias("mask"), "p_rest")
    beside = beside.select("p_fp", "seg", "key", F.col("p_rest").bitwiseXOR(F.col("mask")).alias("rest"))
    across = ordered(beside.join(inside.hint("merge"), ["seg", "key", "rest"]).where(close))
    return found.unionByName(within).unionByName(across).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node reachable. Large-star and small-star steps until nothing changes."""
    edges = materialize(edges.select("a", "b").where("a <> b"), f"{name}-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: larger end first; link each smaller neighbour and the node itself to the smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), f"{name}-edges")
        tops = new.select("a").distinct()
        if new.join(tops.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and new.groupBy("b").count().where("count > 1").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = new


def roots(distinct: DataFrame) -> DataFrame:
    """fp, root of the fingerprints with a link to another text; the rest are their own class."""
    tree = components(links(distinct.select("fp")), "simhash")
    return materialize(tree.select(F.col("node").alias("fp"), "root").unionByName(tree.select(F.col("root").alias("fp"), "root").distinct()), "simhash-linked")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of at most 2 bits reach."""
    prints = materialize(fingerprints(docs), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "simhash-distinct")
    linked = roots(distinct)
    classes = distinct.join(linked, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = distinct.join(linked.join(classes, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"), "copies")
    # copies of a frequent text are not sent to one task: the few such fingerprints go to where the documents are
    many = materialize(ids.where(F.col("copies") > MANY_COPIES).drop("copies"), "simhash-many")
    n_many = many.count()
    rare = prints.join(small_side(many.select("fp"), n_many), "fp", "left_anti").join(ids.where(F.col("copies") <= MANY_COPIES).drop("copies"), "fp")
    placed = rare.unionByName(prints.join(small_side(many, n_many), "fp").select(*rare.columns))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: one with the class's smallest doc_id, or any if no row of the class has an id.

    Each row is judged by its own fingerprint, so rows that share a doc_id, or have none, but differ in text stay apart. A row is known by a 128-bit hash of
    all its columns; of rows that are equal in every column one stays.
    """
    rows = hashed(docs)
    key = F.struct("_h1", "_h2").alias("key")
    seen = rows.select(key, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = seen.mapInArrow(_keyed_fingerprints, "key struct<_h1:long,_h2:long>, doc_id long, fp long")
    # equal rows meet in partial counts, fingerprints in partial minima
    prints = materialize(prints.groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "key", "n")).alias("first")
    distinct = materialize(prints.groupBy("fp").agg(first), "simhash-distinct")
    classes = distinct.join(roots(distinct), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keep = materialize(classes.select(F.col("first.key._h1").alias("_h1"), F.col("first.key._h2").alias("_h2"), F.col("first.n").alias("n")), "simhash-keep")
    side = lambda df: small_side(df.select("_h1", "_h2"), df.count(), KEY_ROWS)
    single = rows.join(side(keep.where("n = 1")), ["_h1", "_h2"], "left_semi")
    equal = rows.join(side(keep.where("n > 1")), ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"])
    return single.unionByName(equal).drop("_h1", "_h2")


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with two 64-bit hashes of all columns, _h1 and _h2. Maps, which have no hash, are hashed as their text."""
    own = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    null = [F.col(f"`{c}`").isNull() for c in docs.columns]  # a hash passes over nulls
    return docs.withColumns({"_h1": F.xxhash64(F.lit(1), *own, *null), "_h2": F.xxhash64(F.lit(2), *null, *own)})


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprint_texts(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["key", "doc_id", "fp"])
