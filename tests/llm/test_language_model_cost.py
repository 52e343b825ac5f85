"""op3_language_model, third review: each test fails on the code before. The same model for less work."""

import numpy as np
import pyarrow as pa
import pytest

from eqspark.llm import gru, language_model


def _model(short=20, n_classes=4):
    hot = [(b"w%d" % i, 50 - i) for i in range(30)]
    tails = {language_model.tail_class(b"zz"): (40 + sum(c for _, c in hot), 10 + len(hot))}
    v = language_model.Vocabulary(hot, 9, tails, short=short, n_classes=n_classes)
    return v, language_model.initial(v)


def test_lanes_stay_full_beside_long_texts():
    rng = np.random.default_rng(2)
    v, p = _model()
    w = language_model.scoring_weights(p)
    texts = [np.append(rng.integers(1, v.n_short + language_model.N_TAIL, 3000 if i % 40 == 7 else rng.integers(0, 60)), 0).astype(np.int32) for i in range(400)]
    scorer = language_model.Scorer(w, v, 8, 16)
    got = dict(x for k in range(0, 400, 50) for x in scorer.score([(i, texts[i]) for i in range(k, k + 50)], k == 350))
    alone = [language_model.score_sequences([t], w, v)[0] for t in texts]
    assert sorted(got) == list(range(400)) and [got[i] for i in range(400)] == pytest.approx(alone, abs=1e-3)
    assert scorer.steps < sum(map(len, texts)) / 8 + 3000  # chunk by chunk each would take the 3000 steps of its longest text


def test_few_tokens_wait():
    v, p = _model()
    texts = [np.append(np.ones(900, np.int32), 0).astype(np.int32) for _ in range(60)]
    scorer = language_model.Scorer(language_model.scoring_weights(p), v, 8, 16, held=2000)
    done = []
    for i, t in enumerate(texts):
        done += scorer.score([(i, t)], i == 59)
        assert i == 59 or sum(len(t.ids) for t in [*scorer.waiting, *filter(None, scorer.begun)]) <= 2000
    assert sorted(k for k, _ in done) == list(range(60)) and len({round(x, 3) for _, x in done}) == 1


def test_a_window_in_reused_rooms_is_the_layer():
    rng = np.random.default_rng(3)
    k, layer = 5, gru.Layer(7, 4, 5, True)
    table, u = rng.standard_normal((11, 3 * k)).astype(np.float32), rng.standard_normal((k, 3 * k)).astype(np.float32)
    for steps in (7, 3):
        x, begin, h, dout = rng.integers(0, 11, (steps, 4)), rng.random((steps, 4)) < 0.3, rng.uniform(-1, 1, (4, k)).astype(np.float32), rng.standard_normal((steps, 4, k)).astype(np.float32)
        keep = (~begin)[:, :, None].astype(np.float32)
        want, cache = gru.forward(table[x], h, u, keep)
        dxg, du = gru.backward(dout, cache, u, keep)
        assert np.allclose(layer.forward(gru.gatewise(table), x, h, gru.gatewise(u), begin), want, atol=1e-6)
        (dn, dr, dz), own = layer.backward(dout, u, begin)
        assert np.allclose(np.concatenate([dr, dz, dn], axis=-1), dxg, atol=1e-5) and np.allclose(own, du, atol=1e-5)


@pytest.mark.parametrize("large", [False, True])
def test_gradients_of_a_window(large):
    """The step that Adam is given is the slope of the likelihood; logits beyond any bound take the safe way."""
    rng = np.random.default_rng(4)
    v, p = _model()
    if large:
        p["bo"][:] = 90
        p["bc"][:] = -90
    x, y = rng.integers(0, v.n_short + language_model.N_TAIL, (2, 6, 4)).astype(np.int32)
    begin = np.zeros((6, 4), bool)
    begin[0] = True
    seen = {}

    class Keep:
        update = staticmethod(seen.update)

    def loss(q):
        states = gru.Layer(6, 4, language_model.HIDDEN, False).forward(gru.gatewise(q["e"] @ q["wx"] + q["b"]), x, np.zeros((4, language_model.HIDDEN), np.float32), gru.gatewise(q["u"]), begin)
        return -language_model.log_likelihood(states.reshape(-1, language_model.HIDDEN), y.reshape(-1), language_model.scoring_weights(q), v).mean()

    language_model._train_window(x, y, begin, np.zeros((4, language_model.HIDDEN), np.float32), p, v, Keep, gru.Layer(6, 4, language_model.HIDDEN, True))
    assert seen.keys() == p.keys() and all(seen[k].shape == p[k].shape for k in p)
    for k in p:
        way = rng.standard_normal(p[k].shape).astype(np.float32)
        up, down = (loss(p | {k: p[k] + s * 3e-3 * way}) for s in (1, -1))
        assert float((seen[k] * way).sum()) == pytest.approx((up - down) / 6e-3, rel=0.03, abs=2e-3)


def test_adam_without_decay_stays_in_its_precision():
    rng = np.random.default_rng(5)
    start = {"a": rng.standard_normal((4, 3)).astype(np.float32), "b": rng.standard_normal(5).astype(np.float32)}
    p, m, v = {k: x.astype(float) for k, x in start.items()}, dict.fromkeys(start, 0.0), dict.fromkeys(start, 0.0)
    adam = gru.Adam(start, 0.01)
    for t in range(1, 6):
        g = {k: (rng.standard_normal(x.shape) * (9 if t == 2 else 1)).astype(np.float32) for k, x in start.items()}
        scale = min(1, 5 / np.sqrt(sum((x.astype(float) ** 2).sum() for x in g.values())))
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * scale * g[k], 0.999 * v[k] + 0.001 * (scale * g[k]) ** 2.0
            p[k] -= 0.01 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[k] / (np.sqrt(v[k]) + 1e-8)
        adam.update(g)
        assert all(adam.params[k].dtype == np.float32 and np.allclose(adam.params[k], p[k], atol=1e-6) for k in p)


def test_words_of_a_column():
    """The words of a column, their number and their classes are those of its texts one by one."""
    texts = ["  a B\x0b\n c  ", "", None, "x\x1cy\x85z\u00a0q \u00c0B", "\t", "end", "A.\tlonger, \u4e2d\u6587\u8bcd. considerably", None]
    column = pa.array(["cut off", *texts], pa.string())[1:]
    words, sizes = language_model.split(column)
    want = [language_model.tokens(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [w for ws in want for w in ws]
    assert language_model.tail_classes(words[1:]).tolist() == [language_model.tail_class(w) for w in words.to_pylist()[1:]]
    assert language_model.split(column[:0])[1].tolist() == [] and language_model.split(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]
    cut = list(language_model.pieces(column, 1))
    assert [i for s in cut for i in range(len(texts))[s]] == list(range(len(texts))) and len(cut) > 2
    (b,) = language_model._count(iter([pa.RecordBatch.from_arrays([column], ["text"])]))
    counts = {w: (t, c) for w, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    assert counts[language_model.END] == (-1, 8) and counts[b"a"] == (language_model.tail_class(b"a"), 1) and sum(c for _, c in counts.values()) == 8 + sum(map(len, want))


def test_a_task_keeps_its_texts_over_chunks(monkeypatch):
    """Every text of a task comes out once, null keys and empty texts too, however the chunks fall."""
    v, p = _model()
    hot = pa.array([b"w%d" % i for i in range(30)])

    class Shared:
        value = {"v": v, "w": language_model.scoring_weights(p), "hot": hot, "logs": np.array([*np.log(np.arange(51.0, 21.0, -1)), 0.0]), "tails": np.array([language_model.tail_class(b"w1")] * 31, np.int32)}

    ids, texts = [*range(50), None], [*(" ".join(f"W{(i * j) % 40}" for j in range(1 + 30 * (i % 7 == 3) + i % 5)) for i in range(48)), None, "", "new words new"]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 17], pa.int64()), pa.array(texts[k : k + 17], pa.string())], ["doc_id", "text"]) for k in (0, 17, 34)]

    def run(chunk):
        monkeypatch.setattr(language_model, "CHUNK_TOKENS", chunk)
        return {r["doc_id"]: r for b in language_model._scorer(Shared)(iter(batches)) for r in b.to_pylist()}

    few, all_ = run(20), run(10**6)
    assert few.keys() == all_.keys() == set(ids) and dict(zip(few[None]["rare"], few[None]["times"], strict=True)) == {b"new": 2, b"words": 1}
    assert few[48]["n_tokens"] == few[49]["n_tokens"] == 1 and all(few[i]["model"] == pytest.approx(all_[i]["model"], abs=1e-3) and {k: x for k, x in few[i].items() if k != "model"} == {k: x for k, x in all_[i].items() if k != "model"} for i in ids)
