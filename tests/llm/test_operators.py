"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import zlib
from collections import Counter

import numpy as np
import pytest

from eqspark.llm import chat, html_text, language_model, mixing, packing, quality_rules, queries, rule_ensemble, simhash, topk, toxicity
from tests.oracle import DATA, connection, rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, b int, d2 double, p string"


def docs(spark, items):
    """Rows (doc_id, text, lang, source) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, 0, "fp", "h", 1, 2.0, "p") for i, t, lang, s in items], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    items = [(1, "one two three four", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "", ""), (5, long, "de", "b"), (5, "One two three four", "en", "a"), (None, "x y", "en", "a"), (7, "one two three four", "en", "a")]
    return docs(spark, items)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_chat_format", "op7_mixing", "op10_top_k"])
def test_oracles(spark, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    want = connection().execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_quality_rules_odd_rows(odd, none):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == 8 and all(r.base_failed and not r.kept for r in got if r.doc_id != 5)
    whole = next(r for r in got if r.n_words == 30_000)
    assert whole.n_repeat_words == 30_000 and whole.base_failed  # all windows recur
    assert quality_rules.quality_rules(none).count() == 0 and quality_rules.keep_good(odd).columns == odd.columns


def test_repeat_words_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, k, n)) for k, n in ((3, 12), (4, 40), (9, 200), (40, 500), (2, 3), (1, 5), (5, 2))]

    def brute(words):
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(covered)

    df = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.with_base(df).collect()}
    assert got == {i: brute(t.split()) for i, t in enumerate(texts)}


def test_quality_rules_reject_outliers_of_a_group(spark):
    rng = np.random.default_rng(2)
    clean = [(i, " ".join("abcdefgh"[: rng.integers(3, 8)] + str(rng.integers(10_000)) for _ in range(rng.integers(80, 300))), "en", "a") for i in range(150)]
    junk = [(1000 + i, " ".join(f"w{rng.integers(9999)}%%%" for _ in range(120)), "en", "a") for i in range(12)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs(spark, clean + junk)).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_quality_rules_least_determinant(spark):
    """Against numpy: random starts with steps to convergence find no subset of a clearly smaller determinant, and the reported one is its subset's."""
    rng = np.random.default_rng(12)
    n, d = 400, quality_rules.DIM
    x = np.round(rng.multivariate_normal(np.zeros(d), np.eye(d) + 0.6, n) * 300 * np.array(quality_rules.FLOORS) + 1000).astype(int)
    x[:80] = np.round(rng.normal(4000, 20, (80, d)))  # a far cluster
    df = spark.createDataFrame([(2, "1en", "1a", *map(int, v)) for v in x], "level int, g_lang string, g_source string, " + ", ".join(f"v{k} long" for k in range(d)))
    ridge = np.diag(quality_rules.RIDGE * (np.array(quality_rules.FLOORS) * quality_rules.SCALE) ** 2)

    def step(rows):
        mean, cov = x[rows].mean(axis=0), np.cov(x[rows].T, bias=True) + ridge
        far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        b = np.floor(quality_rules.LOG_STEPS * np.log(1 + far))
        return np.flatnonzero(b <= np.sort(b)[int(np.ceil(quality_rules.H_SHARE * n)) - 1]), np.sqrt(np.linalg.det(cov))

    least = np.inf
    for _ in range(30):
        rows = rng.choice(n, 2 * d, replace=False)
        for _ in range(30):
            rows, det = step(rows)
        least = min(least, step(rows)[1])
    got = quality_rules.determinants(df, 1).collect()
    assert len(got) == 1 and got[0].det <= 1.001 * least
    mean = np.array([got[0][f"m{k}"] for k in range(d)])
    factor = np.array([[got[0][f"l{i}_{j}"] if j <= i else 0.0 for j in range(d)] for i in range(d)])
    far = (np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0)
    b = np.floor(quality_rules.LOG_STEPS * np.log(1 + far))
    rows = b <= np.sort(b)[int(np.ceil(quality_rules.H_SHARE * n)) - 1]
    assert factor @ factor.T == pytest.approx(np.cov(x[rows].T, bias=True) + ridge, rel=1e-9) and not rows[:80].any()


PAGE = (
    '<body><div id=top class="site-header"><a href=x>Home</a></div><div class="cookie-notice">We use cookies, many of them, for all sorts of things.</div>'
    "<div id=content><h1>Title here</h1><p>First para, with commas, and &quot;quotes&quot; &amp; more text to be long enough.<p>Second   para\n with <a href=q>link</a>.<ul><li>one<li>two, three</ul>"
    '<form><input><label>x</label></form><script>var a="<p>no</p>"</script></div><div class=sidebar><p>Other, stuff, here, long, long, long, long, long, text</div>'
    '<section id="comments"><article class=comment><p>Nice article, really, I liked it a lot, thanks</article></section></body>'
)


def test_html_text(spark):
    assert html_text.main_text(PAGE) == 'Title here\nFirst para, with commas, and "quotes" & more text to be long enough.\nSecond para with link.\none\ntwo, three'
    deep = "<div>" * 3000 + "<p>deep text that is long enough, with a comma, to be kept</p>"
    assert html_text.main_text(deep).startswith("deep text") and html_text.main_text("plain") == "plain" and html_text.main_text("<p>short</p>") == "short"
    df = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (None, "u", "", 1), (1, "u", PAGE, 1)], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.where("false")).count() == 0


ARTICLE = "<p>First para, with commas, and more text to be long enough.</p><p>Second one, also quite long, with more words in it.</p>"
ARTICLE_TEXT = "First para, with commas, and more text to be long enough.\nSecond one, also quite long, with more words in it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="layout with-sidebar">{ARTICLE}</div>', ARTICLE_TEXT),
        (f'<div id="post" class="no-comments">{ARTICLE}</div>', ARTICLE_TEXT),
        (f'<div data-id="nav">{ARTICLE}</div>', ARTICLE_TEXT),
        (f'<div class="page-sidebar">{ARTICLE}</div>', ARTICLE_TEXT),
        (f'<form class=main><div class=nav><a href=x>Home</a></div><div>{ARTICLE}</div></form>', ARTICLE_TEXT),
        (f'<div aria-hidden="true">{ARTICLE}</div><div role="dialog">Sign up now, please</div>', ARTICLE_TEXT),
        (f'<div>{ARTICLE}<p>Text, with <a title="A hidden gem">linked words</a> inside.</p></div>', ARTICLE_TEXT + "\nText, with linked words inside."),
        (f'<div>{ARTICLE}<p class="notice-board">The board, of the town.</p></div>', ARTICLE_TEXT + "\nThe board, of the town."),
        (f"<article><header><h1>Title</h1></header>{ARTICLE}</article>", "Title\n" + ARTICLE_TEXT),
        (f"<header><h1>Site</h1></header><div>{ARTICLE}</div>", ARTICLE_TEXT),
        (f'<div>{ARTICLE}</div><div class="post-comments">{3 * ARTICLE}</div>', ARTICLE_TEXT),
        (f'<div>{ARTICLE}</div><div class="cookie-banner">We use cookies, as all do, for many things.</div>', ARTICLE_TEXT),
        (f'<div hidden><p>Hidden, long, long, long, long, long text.</p></div><div>{ARTICLE}</div>', ARTICLE_TEXT),
        (f'<p title="no end>{ARTICLE}', ARTICLE_TEXT),
        (f"<title>never ended<div>{ARTICLE}</div>", ARTICLE_TEXT),
        (f"<!-- <p>no</p> --><div>{ARTICLE}</div><!-- no end", ARTICLE_TEXT),
        ("a < b and 3 <4 <b", "a < b and 3 <4 <b"),
        ('<p>kept</p><a href="cut off', "kept"),
        ("<nav>only this</nav>", "only this"),
        ('<div class="ad">only this</div>', "only this"),
        ("<script>x = 1</script>", ""),
    ],
)
def test_html_text_hints(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("piece", ["<a", '<a x="', "<a x=", "<!--", "<script", "<script>", "<title>", "</", "<a '\"", "<a =", "<div ", "&", "<p><b>", "</b>", "<li>", '<p class="nav">', "<a /"])
def test_html_text_is_linear(piece):
    import time

    began = time.process_time()
    html_text.main_text(piece * 20_000)
    assert time.process_time() - began < 4


def test_html_text_templates():
    """Pages of varied templates around known texts, compared whole, line breaks included."""
    rng = np.random.default_rng(6)
    pick = lambda *x: x[rng.integers(len(x))]
    for _ in range(300):
        lines = [" ".join(pick("alpha", "be,ta", "gam.ma", "dél&ta", "a<b", "x") for _ in range(rng.integers(8, 40))) for _ in range(rng.integers(3, 9))]
        body = "".join(f"<{t}{pick('', ' data-id=nav', ' class=text-share-none', ' title=\'hidden\'')}>{x.replace('&', '&amp;').replace('<', '&lt;').replace(' ', pick(' ', '  ', chr(10)))}</{t}>" for x in lines for t in [pick("p", "p", "blockquote")])
        body = f"<{(w := pick('article', 'div', 'main', 'section'))} class='{pick('post', 'with-sidebar', 'no-comments', 'content-area', 'x')}'>{body}</{w}>"
        if pick(0, 1):
            body = f"<div id={pick('page', 'wrapper', 'has-nav', 'layout-sidebar')}>{body}</div>"
        before = pick("", "<nav><a href=a>One</a></nav>", "<div class='site-header'><a href=x>Home</a> Site</div>", "<div id=cookie-notice><p>We use cookies, dear reader, as all do.</p></div>")
        after = pick("", "<footer>Imprint, and more, of this site, dear reader</footer>", "<aside><p>Other, things, to read, here, now, and then</p></aside>", "<div class=comments><p>I like it, really, so much, thanks</p></div>", "<ul class='related-posts'><li><a href=x>More</a></ul>")
        assert html_text.main_text(f"<!doctype html><html><head><title>T</title></head><body>{before}{body}{after}</body></html>") == "\n".join(lines)


def test_html_text_whole_table(spark):
    import html
    import re

    for r in queries.op2_html_text(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\n", body)))
        want = "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in body.split("\n")) if x)
        assert r.text == want


def test_language_model(spark, odd, none):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    both = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    counts: Counter = Counter()
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in both.items():
        if not out(i):
            counts.update([*language_model.tokens(t), b" "])
    total, types = sum(counts.values()), len(counts)
    gain = []
    for r in language_model.score_documents(table).collect():
        words = [*language_model.tokens(both[r.doc_id]), b" "]
        want = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        if r.held_out:
            gain.append(r.score - r.base_score)
    assert np.mean(gain) > 0
    assert language_model.score_documents(odd).count() == 8 and language_model.score_documents(none).count() == 0


def test_language_model_score_brute_force(spark, monkeypatch):
    """Step by step in plain Python: one text after the other, one gate after the other, with hot words that are few."""
    import math

    monkeypatch.setattr(language_model, "HOT", 700)
    monkeypatch.setattr(language_model, "TRAIN_DOCS", 40)
    table = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    model = language_model.fit(table)
    counts = {bytes(r.word): r.c for r in model.counts.collect()}
    assert 0 < len(model.hot) <= 700 and all(counts[w] == c for w, c in model.hot) and min(c for _, c in model.hot) >= max((c for w, c in counts.items() if w != b" " and w not in dict(model.hot)), default=0)
    v, p = model.vocabulary, {k: x.astype(float) for k, x in model.weights.items()}
    in_class = {t: [0, 0] for t in range(language_model.N_TAIL)}
    for w, c in counts.items():
        if w != b" " and w not in v.ids:
            in_class[language_model.tail_class(w)][0] += c
            in_class[language_model.tail_class(w)][1] += 1
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n = language_model.HIDDEN

    def brute(text):
        h, last, total = np.zeros(n), 0, 0.0
        for word in [*language_model.tokens(text), None]:
            tail = word is not None and word not in v.ids
            at = 0 if word is None else v.n_short + language_model.tail_class(word) if tail else v.ids[word]
            x = p["e"][last] @ p["wx"] + p["b"]
            u = h @ p["u"]
            reset, update = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
            h = (1 - update) * np.tanh(x[2 * n :] + reset * u[2 * n :]) + update * h
            out = h @ p["wc"] + p["bc"]
            of = v.n_freq + language_model.tail_class(word) if tail else int(v.class_of[at])
            total += out[of] - math.log(np.exp(out).sum())
            if tail:
                c, k = in_class[language_model.tail_class(word)]
                total += math.log((counts.get(word, 0) + 1) / (c + k + 1))
            else:
                mates = [i for i in range(v.n_short) if v.class_of[i] == of]
                logits = h @ p["wo"][:, mates] + p["bo"][mates]
                total += logits[mates.index(at)] - math.log(np.exp(logits).sum())
            last = at
        return total / math.log(10)

    got = {r.doc_id: r.score for r in language_model.score_with(table, model).collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    for i in sorted(texts, key=lambda i: len(texts[i]))[:25]:
        assert got[i] == pytest.approx(brute(texts[i]), rel=1e-4, abs=1e-3)


def test_language_model_memory_of_one_long_text():
    """Scoring needs memory for the tokens, not for tokens times texts."""
    import tracemalloc

    v = language_model.Vocabulary([(b"w%d" % i, 50 - i) for i in range(30)], 9, {}, short=20, n_classes=4)
    w = language_model.scoring_weights(language_model.initial(v))
    seqs = [np.array([1, 2, 0], np.int32)] * 255 + [np.append(np.ones(20_000, np.int32), 0).astype(np.int32)]
    tracemalloc.start()
    language_model.score_sequences(seqs, w, v)
    assert tracemalloc.get_traced_memory()[1] < 8e6
    tracemalloc.stop()


def test_language_model_short_list_grows():
    assert language_model.short_size(0) == (2000, 40) and language_model.short_size(10**6) == (2000, 40)
    assert language_model.short_size(4 * 10**6) == (4000, 57) and language_model.short_size(10**12) == (language_model.HOT, 283)
    assert (language_model.EMBED, language_model.HIDDEN) == (24, 32)


def test_language_model_trains_on_all_documents(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    counts: Counter = Counter()
    texts = {True: [], False: []}
    for i, t in table.collect():
        texts[zlib.crc32(str(i).encode()) % 7 == 2].append(language_model.tokens(t))
    for words in texts[False]:
        counts.update(words)
    total = sum(counts.values()) + len(texts[False])
    tails: dict = {}
    for w, c in counts.items():
        n, k = tails.get(language_model.tail_class(w), (0, 0))
        tails[language_model.tail_class(w)] = (n + c, k + 1)
    v = language_model.Vocabulary(counts.most_common(5000), len(texts[False]), tails, 500, 20)
    ids = {held: [language_model._to_ids(words, v) for words in texts[held]] for held in texts}
    start = language_model.train(ids[False][:3], v)
    got, seen = language_model.train_all(table, v, start, total, total // 6, 2)
    assert seen == total
    other, _ = language_model.train_all(table.repartition(3), v, start, total, total // 6, 2)
    assert all(np.array_equal(got[k], other[k]) for k in got)
    score = lambda p: language_model.score_sequences(ids[True], language_model.scoring_weights(p), v).sum()
    assert score(got) > score(start)


def test_language_model_windows_do_not_matter():
    rng = np.random.default_rng(0)
    hot = [(b"w%d" % i, 50 - i) for i in range(30)]
    tails = {language_model.tail_class(b"zz"): (40 + sum(c for _, c in hot), 10 + len(hot))}
    v = language_model.Vocabulary(hot, 9, tails, short=20, n_classes=4)
    w = language_model.scoring_weights(language_model.initial(v))
    seqs = [np.append(rng.integers(1, v.n_short + language_model.N_TAIL, n), 0).astype(np.int32) for n in (0, 1, 5, 80, 33)]
    a, b = (language_model.score_sequences(seqs, w, v, lanes, window) for lanes, window in ((2, 7), (5, 64)))
    assert np.allclose(a, b, atol=1e-3) and (a < 0).all()


def test_chat(spark):
    t = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", None), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", ""), (5, None, None, "x"), (None, 0, "user", "z"), (6, 0, "user", "a"), (6, 1, "assistant", "b"), (6, 2, "user", "")]
    df = spark.createDataFrame([(*r, 1) for r in t], "conv_id long, turn long, role string, text string, position int")
    got = chat.format_chats(df).collect()
    assert {r.conv_id for r in got} == {3, 4, 5} and sum(r.conv_id == 4 for r in got) == 3  # 1 and 2 are prefixes, 6 repeats 4; null is not the empty text
    assert next(r.rendered for r in got if r.conv_id == 5) == "<|im_start|>unknown\nx<|im_end|>\n"
    assert chat.format_chats(df.where("false")).count() == 0


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("full", [1, 3, 64])
def test_simhash_links(spark, monkeypatch, full):
    """Dense clusters, with buckets that are full early or never."""
    monkeypatch.setattr(simhash, "FULL_BUCKET", full)
    rng = np.random.default_rng(full)
    prints = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(8):
            prints.add(x)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    prints = sorted(prints, key=signed)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    tree = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(dict(enumerate(prints)))
    for i, x in enumerate(prints):
        assert tree.get(signed(x), signed(x)) == signed(prints[want[i]])


def test_simhash_documents(spark, odd, none, monkeypatch):
    monkeypatch.setattr(simhash, "MANY_COPIES", 2)
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    got = simhash.simhash_components(table).collect()
    want = brute_components({r.doc_id: int(r.fingerprint, 16) for r in got})
    assert all(want[r.doc_id] == r.component_id for r in got) and len(got) == table.count()
    by_id = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(odd).collect()]
    assert len(by_id) == 8 and {c for i, f, c in by_id if f == "0" * 16} == {2} and all(c == 1 for i, f, c in by_id if i in (1, 7))
    assert simhash.simhash_components(none).count() == 0
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in simhash.keep_one(odd).collect()) == [(0, 3), (1, 18), (2, 0), (5, max(len(r.text or "") for r in odd.collect()))]
    assert simhash.keep_one(odd).columns == odd.columns


def test_fingerprints_brute_force():
    import xxhash

    for text in ("a b c d", "One TWO three four five", "x", "x y", "é ß ü ö", ""):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(simhash.fingerprint_texts([text])[0]) == want


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    tokenizer = Tokenizer.from_file(path)
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in table.collect()}
    got = packing.pack(table, path).collect()
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, own in ids.items():
        assert sorted(x for r in got if r.doc_id == i for x in range(r.start, r.start + r.length)) == list(range(len(own)))
    windows: dict = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(windows)) > 0.95
    assert sum(r.doc_tokens == 1 for r in packing.pack(odd, path).collect()) == 3 and packing.pack(none, path).count() == 0


def test_packing_words_equal_whole_texts():
    w = packing.WordIds(queries.tokenizer_path(), keep=5)
    texts = ["<|ENDOFTEXT|> a", "İI İ É é, Σ ΑΣ. x'S it's don't, «a», a».", "<|endoftext|>", "1,000.50! ½, ².", "\x01a\x02, b", "", "  ", "Á. é!"]
    for _ in range(2):
        want = [np.array(e.ids, "<u4").tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert w.encode(texts) == want


def test_karmarkar_karp():
    sums, window = packing.karmarkar_karp([8, 7, 6, 5, 4], 2)
    assert sorted(sums.tolist()) == [14, 16] and sorted(np.bincount(window, [8, 7, 6, 5, 4]).tolist()) == [14, 16]
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        sizes = rng.integers(1, 513, n).tolist()
        groups = packing.windows_of(sizes)
        assert sorted(i for g in groups for i in g) == list(range(n)) and all(sum(sizes[i] for i in g) <= 2048 for g in groups)


def test_mixing(spark, odd, none):
    got = mixing.mix(odd)
    assert got.count() == 8 and mixing.mix(none).count() == 0 and mixing.keep_mixed(odd).columns == odd.columns
    cells = [(s, lang, t, n) for s, lang, t, n in (("a", "x", "p", 900), ("a", "y", "p", 100), ("b", "x", "p", 100), ("b", "y", "q", 400), (None, "y", "q", 50))]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    raked = mixing.rake(df, sweeps=40).collect()
    by = lambda k: {v: sum(r.w for r in raked if getattr(r, k) == v) for v in {getattr(r, k) for r in raked}}
    for k in ("source", "lang", "topic"):
        want = {getattr(r, k): getattr(r, f"target_{k}") for r in raked}
        assert by(k) == pytest.approx(want, rel=0.02)
    assert max(r.p for r in raked) == pytest.approx(1)


def test_rule_ensemble(spark, odd, none, labels):
    table, marks = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    truth = {r.doc_id: r.quality for r in marks.collect()}
    got = rule_ensemble.score_documents(table, marks).collect()
    known = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got) and np.mean([p == y for p, y in known]) >= 0.8
    assert rule_ensemble.score_documents(odd, labels).count() == 8 and rule_ensemble.score_documents(none, labels).count() == 0
    assert {r.score for r in rule_ensemble.score_documents(odd, labels.where("false")).collect()} == {0.5}


def test_rules_are_paths_of_trees():
    """Every rule holds for a sensible share of rows, and each tree's sibling rules part the rows of their parent."""
    rng = np.random.default_rng(9)
    x = {s: rng.random(300).round(4) for s in rule_ensemble.STATISTICS}
    y = ((x["symbols"] > 0.5) ^ (x["digits"] > 0.7)).astype(float)
    rules = rule_ensemble.grow_rules(x, y, trees=1)
    assert all(8 <= r.holds(x).sum() <= 292 or len(r.terms) > 1 for r in rules) and len({r.terms for r in rules}) == len(rules)
    top = [r for r in rules if len(r.terms) == 1]
    assert len(top) == 2 and (top[0].holds(x) ^ top[1].holds(x)).all()


def test_lasso_meets_its_optimality_conditions():
    """Against an independent solver: the gradient of an active weight is the penalty, of an inactive one at most that; and plain coordinate descent agrees."""
    rng = np.random.default_rng(10)
    m = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * m[:, 0] - 2 * m[:, 3] + 0.3)))).astype(float)
    penalty = 0.01
    b, w = rule_ensemble.lasso(m, y, penalty, 4000)
    d = 1 / (1 + np.exp(-(m @ w + b))) - y
    grad = m.T @ d / len(y)
    assert abs(d.mean()) < 1e-6 and all(abs(g + np.sign(v) * penalty) < 1e-5 if v else abs(g) <= penalty + 1e-6 for g, v in zip(grad, w)) and 0 < (w != 0).sum() < 12
    v, c = np.zeros(12), 0.0
    for _ in range(3000):
        for j in range(-1, 12):
            d = 1 / (1 + np.exp(-(m @ v + c))) - y
            if j < 0:
                c -= 4 * d.mean()
            else:
                new = v[j] - 4 * (m[:, j] @ d) / len(y)
                v[j] = np.sign(new) * max(abs(new) - 4 * penalty, 0)
    assert w == pytest.approx(v, abs=1e-4) and b == pytest.approx(c, abs=1e-4)


def test_rule_columns_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = {s: rng.random(400).round(6) for s in rule_ensemble.STATISTICS}
    y = ((x["symbols"] > 0.6) | ((x["marks"] > 0.5) & (x["lines"] <= 0.3))).astype(int)
    e = rule_ensemble.fit(x, y)
    assert 0 < len(e.rules) < 60 and np.mean((e.score(x) >= 0.5) == y) > 0.97
    df = spark.createDataFrame([(i, *(float(x[s][i]) for s in rule_ensemble.STATISTICS)) for i in range(400)], "i int, " + ", ".join(f"{s} double" for s in rule_ensemble.STATISTICS))
    got = [r[1] for r in df.select("i", e.column()).orderBy("i").collect()]
    assert got == pytest.approx(e.score(x).tolist(), abs=1e-9)


def test_toxicity(spark, odd, none, labels):
    table, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    got = toxicity.score_documents(table, marks).collect()
    known = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert len(got) == table.count() and np.mean([p == y for p, y in known]) >= 0.93
    assert toxicity.score_documents(odd, labels).count() == 8 and toxicity.score_documents(none, labels).count() == 0
    kept = toxicity.keep_civil(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= 8


def test_keep_one_by_row(spark):
    """Copies without an id are deduplicated, and rows that share an id but not a text are kept apart."""
    a, b, c = "alpha beta gamma delta one", "quite another text of words", "a third text that stands alone"
    items = [(None, a, "en", "x"), (None, a, "en", "x"), (None, c, "en", "x"), (5, b, "en", "x"), (5, c, "en", "y"), (5, b, "en", "z"), (9, b, "en", "x")]
    kept = simhash.keep_one(docs(spark, items))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, a), (5, b), (5, c)])


def test_keep_civil_by_row(spark, monkeypatch):
    """A toxic row takes no other row with it that has the same id or none."""

    def scorer(shared):
        import pyarrow as pa

        def run(batches):
            for x in batches:
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([float("bad" in (t or "")) for t in x.column(1).to_pylist()])], ["doc_id", "score"])

        return run

    monkeypatch.setattr(toxicity, "fit", lambda *_: (None, None))
    monkeypatch.setattr(toxicity, "_scorer", scorer)
    table = docs(spark, [(None, "bad one", "en", "x"), (None, "fine", "en", "x"), (None, None, "en", "x"), (5, "bad two", "en", "x"), (5, "good", "en", "x"), (6, "good", "en", "x")])
    kept = toxicity.keep_civil(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [(0, ""), (0, "fine"), (5, "good"), (6, "good")]
    assert kept.columns == table.columns


def test_mixing_meets_targets_beside_a_tiny_cell(spark):
    """Probabilities are as small as the targets ask for, so that kept tokens follow the targets."""
    rows = [("big", "en", "t", 4 * 10**10), ("mid", "en", "t", 10**10), ("big", "de", "t", 2 * 10**10), ("mid", "de", "t", 10**10), ("tiny", "xx", "t", 10), ("tiny", "en", "t", 1000), ("big", "xx", "t", 1000)]
    seen = spark.createDataFrame(rows, "_eq_source string, _eq_lang string, _eq_topic string, _eq_tokens long")
    got = [r._mix_p for r in mixing._with_probability(seen, seen).collect()]
    assert min(got) < 0.05 and max(got) == 1.0
    with pytest.warns(UserWarning, match="marginal"):  # a source and language that are one cell have two targets
        mixing.rake(spark.createDataFrame([("a", "en", "t", 10**6), ("b", "xx", "t", 10)], "source string, lang string, topic string, tokens long"))


def test_mixing_stops_at_its_targets(spark):
    """Sweeps go on until the marginals are met, however slowly, and give plain numpy's weights."""
    rng = np.random.default_rng(13)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(10 ** rng.uniform(1, 7))) for i in range(4) for j in range(3) for k in range(2) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    raked = mixing.rake(df)
    assert mixing.marginal_gap(raked) < 1e-8
    w = {c[:3]: float(c[3]) for c in cells}
    target = [{}, {}, {}]
    for d, power in enumerate((mixing.SOURCE_POWER, mixing.LANG_POWER, 1.0)):
        for c in cells:
            target[d][c[d]] = target[d].get(c[d], 0) + c[3]
        scaled = {k: v**power for k, v in target[d].items()}
        target[d] = {k: v * sum(c[3] for c in cells) / sum(scaled.values()) for k, v in scaled.items()}
    for _ in range(400):
        for d in range(3):
            sums: dict = {}
            for c, v in w.items():
                sums[c[d]] = sums.get(c[d], 0) + v
            w = {c: v * target[d][c[d]] / sums[c[d]] for c, v in w.items()}
    for r in raked.collect():
        assert r.w == pytest.approx(w[r.source, r.lang, r.topic], rel=1e-6)


def test_toxicity_gradient():
    """Backward steps of the recurrent layer against differences."""
    from eqspark.llm import gru

    rng = np.random.default_rng(0)
    xg, u, h0 = rng.standard_normal((5, 3, 12)), rng.standard_normal((4, 12)), rng.standard_normal((3, 4))
    weight = rng.standard_normal((5, 3, 4))
    loss = lambda a, b: float((gru.forward(a, h0, b)[0] * weight).sum())
    dxg, du = gru.backward(weight, gru.forward(xg, h0, u)[1], u)
    for target, grad in ((xg, dxg), (u, du)):
        for _ in range(8):
            at = tuple(int(rng.integers(n)) for n in target.shape)
            old = target[at]
            target[at] = old + 1e-6
            up = loss(xg, u)
            target[at] = old - 1e-6
            assert (up - loss(xg, u)) / 2e-6 == pytest.approx(grad[at], rel=1e-4, abs=1e-6)
            target[at] = old


def test_toxicity_brute_force():
    """The largest window's probability, step by step in both directions, with attention over the steps, in plain loops."""
    rng = np.random.default_rng(8)
    words = [f"wörd{k}".encode() for k in range(60)] + [b"bad.", b"(evil)", b"x"]
    texts = [[words[j] for j in rng.integers(len(words), size=n)] for n in (1, 7, 64, 65, 150, 0, 300)]
    e = toxicity.Encoder([[*texts[4], b"bad."], *texts[:4], *texts[5:]], np.array([1, 0, 1, 0, 1, 0, 0]))
    p = {k: x.astype(float) for k, x in toxicity.initial(e).items()}
    n = toxicity.HIDDEN

    def vector(w):
        codes, _ = toxicity.trigrams([w])
        return np.concatenate([p["ew"][e.ids_of([w])[0]], p["ec"][codes].mean(axis=0), p["eh"][toxicity.heads([w])[0]].sum(axis=0)])

    def pass_over(xs, d):
        h, out = np.zeros(n), []
        for x in xs:
            a, u = x @ p[f"wx{d}"] + p[f"b{d}"], h @ p[f"u{d}"]
            r, z = 1 / (1 + np.exp(-a[:n] - u[:n])), 1 / (1 + np.exp(-a[n : 2 * n] - u[n : 2 * n]))
            h = (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :]) + z * h
            out.append(h)
        return out

    def probability(window):
        xs = [vector(w) for w in window]
        states = [np.concatenate(x) for x in zip(pass_over(xs, "f"), pass_over(xs[::-1], "r")[::-1])]
        weights = np.exp([np.tanh(h @ p["wa"]) @ p["va"] for h in states])
        pooled = sum(a * h for a, h in zip(weights / weights.sum(), states))
        return 1 / (1 + np.exp(-(pooled @ p["wo"] + p["bo"][0])))

    got = toxicity.score_texts(texts, e, toxicity.initial(e))
    want = [max(probability(t[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(t))) if t else toxicity.EMPTY_SCORE for t in texts]
    assert got == pytest.approx(want, abs=1e-5)


def test_toxicity_learns_more_than_its_start(spark):
    """Held-out rank quality of the trained network against the class frequencies that its tables start from, taken alone: the most suspicious window's sum."""
    table, marks = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    texts, y = toxicity.sample(table, marks, 1500)
    assert 1000 < len(texts) <= 1500
    half = len(texts) // 2
    e, p = toxicity.train(texts[:half], y[:half])

    def area(scores):
        order = np.argsort(scores, kind="stable")
        rank = np.empty(len(order))
        rank[order] = np.arange(1, len(order) + 1)
        own = y[half:] == 1
        return (rank[own].sum() - own.sum() * (own.sum() + 1) / 2) / (own.sum() * (~own).sum())

    def prior(words):
        own = e.word_start[e.ids_of(words)] + e.head_start[toxicity.heads(words)].sum(axis=1)
        return max(own[at : at + toxicity.WINDOW].sum() for at in toxicity.window_starts(len(words)))

    alone = area(np.array([prior(t) for t in texts[half:]]))
    assert area(toxicity.score_texts(texts[half:], e, p)) > max(0.9, alone), alone


def test_samples_are_bounded(spark):
    """A document that is repeated greatly gives one row, and the limit holds."""
    items = [(i % 200, f"text {i % 200} and more", "en", "a") for i in range(400)] + [(7, "seven", "en", "a")] * 300
    marks = spark.createDataFrame([(i % 200, i % 2, i % 2) for i in range(400)] + [(7, 1, 1)] * 300, "doc_id long, quality int, toxic int")
    texts, y = toxicity.sample(docs(spark, items), marks, 90)
    assert 30 < len(texts) == len(y) <= 90
    whole, _ = toxicity.sample(docs(spark, items), marks, 4000)
    assert len(whole) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))


def test_windows_cover_whole_texts():
    for n in (1, 63, 64, 65, 112, 113, 1000):
        starts = toxicity.window_starts(n)
        assert {j for s in starts for j in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 64)).astype(np.float32)
    x[3] = x[4] = x[5]  # ties
    items = [(i, v.tolist()) for i, v in enumerate(x)] + [(800, None), (900, [float("nan")] * 64), (1000, [1.0, None]), (None, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in items], "vec_id long, embedding array<float>, score int")
    got: dict = {}
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    assert set(got) == {0, 100, 200, 300, 400, 500, 600}
    for q, found in got.items():
        scores = whole @ whole[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert found == [(i, -s) for s, i in want]
    assert topk.top_k(df.where("false")).count() == 0
    few = topk.top_k(df.where("vec_id < 4")).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3]


@pytest.mark.parametrize("scale", [1, 3e6, 1e12, 1e200])
def test_top_k_large_components(spark, monkeypatch, scale):
    """Exact integers of any size; what a long cannot hold is held at its ends, ties to the smaller id."""
    from fractions import Fraction

    for name, value in (("QUERY_BLOCK", 2), ("CANDIDATE_BLOCK", 7), ("SCOUT_BLOCKS", 2), ("CANDIDATE_GROUP", 2), ("GROUPS", 3), ("QUERY_GROUP", 1)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((90, 8)) * np.where(rng.random((90, 1)) < 0.5, scale, 1)
    x[40:60] = x[40]
    ids = [*range(60), *range(100, 118), 100, *([200] * 11)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(300, [1.0, 2.0])], "vec_id long, embedding array<double>").repartition(5)
    whole = [[int(Fraction(c) * 1024 // 1) for c in v] for v in x.tolist()]
    got: dict = {}
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[i], v)))), ids[j]) for i in range(90) if ids[i] == q for j, v in enumerate(whole) if ids[j] != q]
        assert found == [(j, s) for s, j in sorted(scores, key=lambda p: (-p[0], p[1]))[:10]]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_dedup", "mixing", "packing"]
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    step, sizes = table, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, DATA)
        assert step.columns == table.columns
        sizes.append(step.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < table.count()
    ids = {r.doc_id for r in step.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()} == ids
