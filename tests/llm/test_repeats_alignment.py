"""Substring dedup and cross-tokenizer alignment against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from eqspark.llm import alignment, queries, repeats
from tests.oracle import DATA

DOCS = "doc_id long, text string, ord long, k1 string, v double, start int, kind string, batch int, a long"


def docs(spark, items):
    """Rows (doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "k", 2.0, 3, "x", 4, 5) for i, t in items], DOCS)


# --- repeats -----------------------------------------------------------------------------------


def words_of(text):
    return (text or "").encode().split()


def kept_by_brute_force(items, window):
    """(n_words, kept words) by row, rows in the order of ids (nulls last), those of equal id as they come."""
    seen, out = set(), {}
    for at in sorted(range(len(items)), key=lambda k: (items[k][0] is None, items[k][0] or 0)):
        words = words_of(items[at][1])
        removed = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                removed[s : s + window] = [True] * window
            seen.add(w)
        out[at] = (len(words), [w for w, r in zip(words, removed, strict=True) if not r])
    return out


def figures(n, kept):
    text = b" ".join(kept)
    return n, n - len(kept), hashlib.sha256(text).hexdigest()


def found(df, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.without_repeats(df, **options).collect()), key=str)


def expected(items, window=20):
    return sorted(((items[at][0], *figures(*x)) for at, x in kept_by_brute_force(items, window).items()), key=str)


def made_up(seed, n=60):
    """Passages of 15 to 60 words shared among documents, whole copies, words said over and over, and small vocabularies."""
    rng = random.Random(seed)
    say = lambda k, of: [f"w{rng.randrange(of)}" for _ in range(k)]
    passages = [say(rng.randrange(15, 60), 500) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [say(rng.randrange(0, 40), rng.choice((2, 30, 5000)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), say(rng.randrange(0, 30), 5000)]
        if rng.random() < 0.1:
            parts.append(["la"] * rng.randrange(15, 70))
        if out and rng.random() < 0.15:
            parts = [words_of(rng.choice(out)[1])]
            parts = [[w.decode() for w in parts[0]]]
        between = rng.choice((" ", "\n", "\t ", "  "))
        out.append((1000 - i if i % 2 else i, between.join(w for p in parts for w in p)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_brute_force(spark, seed):
    items = made_up(seed)
    got = found(docs(spark, items).repartition(7))
    assert got == expected(items) and sum(r[2] for r in got) > 500


def test_repeats_other_windows(spark):
    items = made_up(4, 30)
    df = docs(spark, items)
    assert found(df, window=8, first=4) == expected(items, 8)
    assert found(df, window=24, first=3) == expected(items, 24)
    with pytest.raises(ValueError, match="doubled"):
        repeats.without_repeats(df, window=20, first=6)


def test_repeats_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(5000))
    passage = " ".join(f"p{k}" for k in range(25))
    items = [(1, None), (2, ""), (3, " \n\t "), (4, "few words"), (5, long), (7, passage), (None, passage), (9, f"x {passage} y"), (8, "é ü\x0b" + passage), (6, f"z {passage}")]
    assert found(docs(spark, items)) == expected(items)
    assert found(docs(spark, items).where("false")) == []


def test_repeats_of_repeated_rows(spark):
    """Of rows equal in id and words one counts as the first; the rest keep nothing. Rows of one id that differ are documents of their own."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = Counter(found(docs(spark, [(1, a)] * 3 + [(2, a + "\n"), (3, b), (3, b + " more"), (4, "short"), (4, "short")])))
    empty = hashlib.sha256(b"").hexdigest()
    whole = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[(1, 30, 0, whole(a))] == 1 and got[(1, 30, 30, empty)] == 2 and got[(2, 30, 30, empty)] == 1 and got[(4, 1, 0, whole("short"))] == 2
    # of the two texts with id 3 one comes first by its hash, and keeps its passage
    assert {r for r in got if r[0] == 3} in ({(3, 30, 0, whole(b)), (3, 31, 30, whole("more"))}, {(3, 31, 0, whole(b + " more")), (3, 30, 30, empty)})


def test_repeats_kept_text(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    got = {r.doc_id: r.kept_text for r in repeats.without_repeats(docs(spark, [(1, passage), (2, f"before  {passage}\nafter"), (3, passage)])).collect()}
    assert got == {1: None, 2: "before after", 3: ""}


def test_word_hashes_over_blocks():
    """Words that cross a block's end, longer than a block, and in several blocks hash as they do alone."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdé") for _ in range(n)) for n in (1, 5, 30, 4000, 40_000, 7, 33_000, 32_768, 2)] + [f"w{k}" for k in range(20_000)]
    x, start = repeats.word_hashes(" ".join(words).encode())
    assert len(x) == len(words) and len(set(x.tolist())) == len(set(words))
    for at in [*range(9), *rng.sample(range(9, len(words)), 200)]:
        assert repeats.word_hashes(words[at].encode())[0][0] == x[at]


def test_chosen_windows_are_in_both_occurrences():
    rng = np.random.default_rng(9)
    passage = rng.integers(1, 2**63, 20).astype(np.uint64)
    for _ in range(50):
        a = np.concatenate([rng.integers(1, 2**63, rng.integers(0, 30)).astype(np.uint64), passage, rng.integers(1, 2**63, rng.integers(0, 30)).astype(np.uint64)])
        b = np.concatenate([rng.integers(1, 2**63, rng.integers(0, 30)).astype(np.uint64), passage])
        for n in (5, 10):
            sets = [set(repeats.Stretches(x, np.array([len(x)]), 20).chosen(n)[1].tolist()) for x in (a, b)]
            own = set(repeats.Stretches(passage, np.array([20]), 20).chosen(n)[1].tolist())
            assert own and own <= sets[0] and own <= sets[1]


# --- alignment ---------------------------------------------------------------------------------


def byte_of_char():
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligned_by_brute_force(items):
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = byte_of_char()

    def b_bytes(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    per, counts = [], Counter()
    for _, text in items:
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        spans = []
        for ids, spell in ((a, lambda i: bytes(chars[c] for c in a_side.id_to_token(i))), (b, b_bytes)):
            parts = [spell(i) for i in ids]
            ends = np.cumsum([len(x) for x in parts]).tolist()
            spans.append([(i, e - len(x), e) for i, x, e in zip(ids, parts, ends, strict=True)] if b"".join(parts) == whole else None)
        if not text or None in spans:
            per.append(None)
            continue
        links = [(x, y) for x, s, e in spans[0] for y, t, u in spans[1] if s < u and t < e]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [[[i for i, _, e in side if lo < e <= hi] for side in spans] for lo, hi in zip([0, *cuts], cuts)]  # noqa: B905
        per.append((len(a), len(b), groups, links))
        counts.update(set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, _), got in zip(items, per, strict=True):
        if got is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = got
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def align(df):
    got = alignment.align_documents(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()), key=str)


ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "a"),
    (5, "The quick brown fox, the quick brown fox."),
    (5, "The quick brown fox, the quick brown fox."),
    (None, "no id <|endoftext|> <s> </s> <0x41>"),
    (6, "tabs\tand\nlines\r\n\x0b and  spaces   "),
    (7, "日本語とemoji 🎧🎶 é é ﬁ   ﻿"),
    (8, "a lower block ▁ is a space to B"),
    (9, "\x00\x01 control"),
    (10, "unbroken" * 200),
    (11, "the the the the THE The tHe"),
]


def test_alignment_brute_force(spark):
    assert align(docs(spark, ODD).repartition(3)) == aligned_by_brute_force(ODD)
    assert align(docs(spark, ODD).where("false")) == []


def test_alignment_in_small_batches(spark, monkeypatch):
    """Batches of a few documents, rows of three postings, sums given on after each: the same figures."""
    rng = random.Random(11)
    say = lambda: " ".join(rng.choice(("the", "quick", "Überraschung", "x1", "fox", "12345", "don't", "naïve")) + rng.choice(("", ",", ".", "\n")) for _ in range(rng.randrange(1, 60)))
    items = [*ODD, *[(100 + i, say()) for i in range(40)]]
    want = aligned_by_brute_force(items)
    encoder = alignment._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    for name, value in (("BATCH_DOCS", 7), ("BATCH_LINKS", 50), ("CHUNK", 60), ("ROW", 3), ("HELD_DOCS", 5)):
        monkeypatch.setattr(alignment, name, value)
    # the parts that tasks run, driven here, as workers do not see the small limits
    batches = []
    for start in range(0, len(items), 5):
        batch = alignment.Batch()
        for i, t in items[start : start + 5]:
            batch.add(encoder, [i], [t])
        batches += list(batch.rows(start))
    rows = spark.createDataFrame([r for b in batches for r in b.to_pylist()], alignment.PACKED)
    cells = rows.where("kind > 0").withColumn("part", F.lit(0)).orderBy("a", "kind").select("a", "part", "kind", "batch", "n", "x", "y", "z")
    import pyarrow as pa

    added = list(alignment._contributions(iter([pa.RecordBatch.from_pylist([r.asDict() for r in cells.collect()], schema=cells._to_arrow_schema() if hasattr(cells, "_to_arrow_schema") else cells.toArrow().schema)])))
    both = pa.Table.from_batches(added).to_pylist() + [{k: r[k] for k in added[0].schema.names} for b in batches for r in b.to_pylist() if r["kind"] == alignment.DOC]
    both.sort(key=lambda r: (r["batch"], -r["kind"]))
    final = pa.Table.from_batches(list(alignment._summed(iter([pa.RecordBatch.from_pylist(both, schema=added[0].schema)])))).to_pylist()
    got = sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in final), key=str)
    assert got == want


def test_frequent_ids_are_dealt_over_tasks(spark):
    """One word in every document: its postings lie in several parts, and each has all counts."""
    items = [(i, " ".join(["the"] * (1 + i % 3) + [f"x{i % 7}"])) for i in range(4000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = align(docs(spark, items).repartition(6))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == aligned_by_brute_force(items)


def test_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op11_repeats", "op12_alignment"):
        assert queries.queries()[name](spark, DATA).count() == n
