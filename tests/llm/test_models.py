"""The two recurrent networks: gradients, defined results, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import bigru, language_id, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string"


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in bigru.init_recurrent(rng, 3).items()}
    x = rng.standard_normal((4, 2, 3, 2, 3))
    weights = rng.standard_normal((4, 2, 6))

    def loss(x, p):
        return float((bigru.both_ways(bigru.forward(x, p)[0]) * weights).sum())

    h, kept = bigru.forward(x, p)
    dx, grads = bigru.backward(bigru.split_ways(weights).astype(np.float32), h, kept, p)
    for array, gradient in ((x, dx), (p["U"], grads["U"]), (p["bn"], grads["bn"])):
        for _ in range(6):
            at = tuple(rng.integers(n) for n in array.shape)
            kept_value, e = array[at], 1e-2
            array[at] = kept_value + e
            up = loss(x, p)
            array[at] = kept_value - e
            down = loss(x, p)
            array[at] = kept_value
            assert gradient[at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=2e-3)


def test_runner_equals_forward():
    rng = np.random.default_rng(1)
    p = bigru.init_recurrent(rng, 4)
    tables = rng.standard_normal((2, 3, 10, 4)).astype(np.float32)
    rows = rng.integers(0, 10, (5, 3))
    both = np.stack([rows, rows[::-1]], 1)
    x = np.stack([tables[way][:, both[:, way]] for way in (0, 1)], 0).transpose(2, 0, 1, 3, 4)
    halved = tables.copy()
    halved[:, :2] *= 0.5
    assert np.allclose(bigru.Runner(p, 5, 3).run(halved, rows)[1:], bigru.forward(x, p)[0][1:], atol=1e-5)


def check_gradients(params, loss_and_grads, rng):
    """Every parameter's gradient against differences, in double precision."""
    _, grads = loss_and_grads()
    assert set(grads) == set(params)
    for name, gradient in grads.items():
        flat, of = params[name].reshape(-1), np.asarray(gradient).reshape(-1)
        frozen = gradient.shape[1] if name[0] == "L" else 0  # row 0 stands for unknown inputs and stays zero
        # the places with the largest gradients, and some others
        for at in {*np.argsort(-np.abs(of))[:4].tolist(), *rng.integers(frozen, len(flat), 4).tolist()}:
            value, e = flat[at], 1e-5
            flat[at] = value + e
            up = loss_and_grads()[0]
            flat[at] = value - e
            down = loss_and_grads()[0]
            flat[at] = value
            assert of[at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-7), name


def test_language_gradients():
    rng = np.random.default_rng(5)
    params = {k: v.astype(np.float64) for k, v in bigru.init_recurrent(rng, 3).items()}
    params |= {"E": rng.standard_normal((2, 3, language_id.PAD + 1, 3)), "V": rng.standard_normal((6, 4)), "c": rng.standard_normal(4)}
    symbols = rng.integers(97, 105, (6, 5))
    symbols[4:, 2] = language_id.PAD
    check_gradients(params, lambda: language_id.gradients(params, symbols, np.array([0, 1, 2, 3, 1])), rng)


def test_toxicity_gradients():
    rng = np.random.default_rng(6)
    steps, batch, inputs, learned, filters, hidden = 5, 4, len(toxicity.INPUTS), 2, 3, 3
    params = {k: v.astype(np.float64) for k, v in bigru.init_recurrent(rng, hidden).items()}
    width = inputs * (1 + learned) + filters
    params |= {"W": rng.standard_normal((2, 3, width, hidden)) / 4, "b": rng.standard_normal((2, 3, 1, hidden)), "A": rng.standard_normal((2 * hidden, 4)), "a": rng.standard_normal(4), "V": rng.standard_normal(2 * hidden), "c": np.zeros(1)}
    params |= {"C": rng.standard_normal((256, 4)) / 2, "K": rng.standard_normal((12, filters)) / 2} | {f"L{i}": rng.standard_normal((6, learned)) for i in range(inputs)}
    for i in range(inputs):
        params[f"L{i}"][0] = 0
    real = np.ones((steps, batch), bool)
    real[3:, 1] = False
    at = np.where(real, rng.integers(1, 6, (inputs, steps, batch)), 0)
    chars = np.where(real[..., None], rng.integers(97, 110, (steps, batch, toxicity.CHARS + 2)), 0).astype(np.uint8)
    chars[..., [0, -1]] = 0
    odds = np.where(real, rng.standard_normal((inputs, steps, batch)), 0)
    check_gradients(params, lambda: toxicity.gradients(params, odds, at, chars, real, np.array([0.0, 1.0, 1.0, 0.0])), rng)


def plain_states(x, p):
    """States of both directions, one step and one direction after the other."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    out = []
    for way in (0, 1):
        h, states = np.zeros(p["U"].shape[-1]), []
        for t in range(len(x)) if way == 0 else reversed(range(len(x))):
            z, r = (sigmoid(x[t][way, g] + h @ p["U"][way, g]) for g in (0, 1))
            n = np.tanh(x[t][way, 2] + r * (h @ p["U"][way, 2] + p["bn"][way, 0]))
            h = n + z * (h - n)
            states.append(h)
        out.append(states if way == 0 else states[::-1])
    return np.concatenate([np.array(out[0]), np.array(out[1])], 1)


def test_toxicity_scorer_equals_plain_forward():
    r = np.random.default_rng(8)
    words = [f"word{i}" for i in range(40)]
    rows = [(i % 2, " ".join(r.choice(words, 30)) + (" vile" if i % 2 else "")) for i in range(40)]
    p = toxicity.ToxicityParams(steps=30, window=16)
    model = toxicity.train(rows, p)
    q, scorer = model.params, toxicity.Scorer(model)
    for text in (b"vile word1 other", " ".join(r.choice(words, 50)).encode(), b"x"):
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        hashes, _ = toxicity.word_inputs(data, offsets)
        at = toxicity.rows_of(model.keys, hashes)
        feature = np.concatenate([*[q[f"T{i}"][at[i]] for i in range(len(at))], toxicity.char_features(toxicity.word_bytes(data, offsets), q)[0]], 1)
        n, best = len(feature), -np.inf
        starts = [0] if n <= 16 else [min(8 * k, n - 16) for k in range(-(-(n - 16) // 8) + 1)]
        for s in starts:
            part = feature[s : s + 16]
            padded = np.concatenate([part, np.zeros((16 - len(part), part.shape[1]))])  # windows are padded with empty words
            x = [np.stack([np.stack([f @ q["W"][way, g] + q["b"][way, g, 0] for g in range(3)]) for way in (0, 1)]) for f in padded]
            states = plain_states(x, q)[: len(part)]
            e = np.tanh(states @ q["A"]) @ q["a"]
            w = np.exp(e - e.max())
            best = max(best, float((w / w.sum()) @ states @ q["V"] + q["c"][0]))
        assert scorer.scores(data, offsets)[0] == pytest.approx(1 / (1 + np.exp(-best)), abs=1e-4)


def test_word_bytes():
    texts = [b"One, two", "café".encode(), b"a" * 10 + b"b" * 10]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [bytes(x).strip(b"\0") for x in toxicity.word_bytes(np.frombuffer(b"".join(texts), np.uint8), offsets)]
    assert got == [b"one", b"two", "café".encode(), b"a" * 8 + b"b" * 8]


# ---- language


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and length(text) > 20").toPandas()
    assert len(out) > 100 and (out.lang_pred == out.lang).mean() >= 0.98
    assert out.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in out.doc_id)


def test_language_odd_rows(spark):
    rows = [(i, t, lang, "s", "x") for i, (t, lang) in enumerate([("the and of to that is with " * 9, "en"), ("der die und nicht mit von " * 9, "de")] * 20)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs, language_id.LanguageParams())
    odd = spark.createDataFrame([(0, None, None, None, ""), (1, "", "en", None, ""), (2, "12 !!", "en", None, ""), (3, "the and of " * 5000, None, None, ""), (None, "die und der nicht mit von der und " * 3, None, None, ""), (5, "漢字", None, None, ""), (3, "the and of " * 5000, "de", "z", "")], DOCS)
    got = language_id.predict(odd, model).collect()
    assert [r.lang_pred for r in got[:5]] == ["und", "und", "und", "en", "de"] and got[5].lang_pred in ("en", "de")
    assert (got[3].lang_pred, got[3].score) == (got[6].lang_pred, got[6].score)
    assert language_id.predict(spark.createDataFrame([], DOCS), model).count() == 0
    none = language_id.fit(spark.createDataFrame([], DOCS))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_predictions_do_not_depend_on_batches():
    rows = [("a", "the and of to"), ("b", "der die und")] * 20
    model = language_id.train(rows, language_id.LanguageParams(steps=20))
    scorer = language_id.Scorer(model)
    texts = [b"the and " * k for k in (0, 1, 16, 17, 40, 200)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = scorer.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert np.allclose(scorer.pooled(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], together[i], atol=1e-5)


def test_language_scorer_equals_plain_forward():
    model = language_id.train([("a", "the and of to"), ("b", "der die und")] * 20, language_id.LanguageParams(steps=20, window=12))
    q = model.params
    for text in (b"the and", b"der die und nicht mit von"):
        total = np.zeros(2)
        for s in range(0, len(text), 12):
            part = [*text[s : s + 12]]
            states = plain_states([q["E"][:, :, b] for b in [*part, *[language_id.PAD] * (12 - len(part))]], q)[: len(part)]
            logits = states @ q["V"] + q["c"]
            total += (np.exp(logits) / np.exp(logits).sum(1, keepdims=True)).sum(0)
        got = language_id.Scorer(model).pooled(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert np.allclose(got, total / len(text), atol=1e-4)


# ---- toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").max("toxic").toDF("doc_id", "toxic")
    out = queries.op6_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert len(toxic) > 50 and (toxic.predicted == 1).mean() >= 0.75 and (clean.predicted == 0).mean() >= 0.98
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_word_inputs_equal_brute_force():
    texts = [b"", b"One two", b"two", b"!!", "café ONE".encode(), b"a" * 50 + b" b"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes, counts = toxicity.word_inputs(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert counts.tolist() == [0, 2, 1, 0, 2, 2]
    assert hashes[0, 0] == hashes[0, 4] and hashes[0, 1] == hashes[0, 2] and len(set(hashes[0].tolist())) == 5
    alone, _ = toxicity.word_inputs(np.frombuffer(b"two", np.uint8), np.array([0, 3]))
    assert (alone[:, 0] == hashes[:, 2]).all()


def test_long_texts_teach_toxicity(spark):
    """All toxic rows are far over ``max_chars``, with the toxic words in one place: they are neither left out nor cut to what is clean in them."""
    r = np.random.default_rng(12)
    words = np.array([f"word{i}" for i in range(400)])
    bad = ["vile slur", "hateful vile thing", "slur and filth"]

    def text(i, toxic):
        own = list(r.choice(words, 3000 if toxic else 80))
        if toxic:
            own[int(r.integers(3000))] = bad[i % 3]
        return " ".join(own)

    rows = [(i, text(i, i % 2)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity.sample(docs, labels, toxicity.ToxicityParams())
    assert sum(y for y, _ in got) == 60 and all(("vile" in t or "slur" in t) and len(t) < 8192 for y, t in got if y)
    model = toxicity.fit(docs, labels.filter("doc_id < 80"))
    held = toxicity.score(docs.filter("doc_id >= 80"), model).collect()
    assert np.mean([x.predicted for x in held if x.doc_id % 2]) >= 0.9 and np.mean([x.predicted for x in held if x.doc_id % 2 == 0]) <= 0.1


def test_toxicity_without_a_label_warns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="both labels"):
        model = toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert {x.score for x in toxicity.score(docs, model).collect()} == {0.0}


def test_toxicity_bound_keeps_both_labels(spark):
    """A repeated id is one row of the sample, so that its copies don't take the others' places."""
    docs = spark.createDataFrame([(1, "same text")] * 50 + [(i, f"text {i}") for i in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 6)) for i in range(1, 12)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, toxicity.ToxicityParams(max_toxic=3, max_clean=3))
    assert sorted(y for y, _ in got) == [0, 0, 0, 1, 1, 1]


def test_toxicity_odd_rows(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choice(words, 80)) + (" vile awful" if i % 3 == 0 else ""), None, None, "") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "clash") for i in range(120)] + [(None, 1, ""), (5, None, "")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels, toxicity.ToxicityParams(steps=150))
    long = " ".join(r.choice(words, 5000)) + " vile awful " + " ".join(r.choice(words, 5000))
    odd = spark.createDataFrame([(0, None, None, None, ""), (1, "", None, None, ""), (2, long, None, None, ""), (None, "w1 w2", None, None, ""), (4, "... ", None, None, ""), (2, long, "x", "y", "")], DOCS)
    got = toxicity.score(odd, model).collect()
    assert got[0].score == got[1].score == got[4].score < 0.5
    assert got[2].predicted == 1 and got[2].score == pytest.approx(got[5].score, abs=1e-5) and got[3].predicted == 0
    clean = toxicity.keep_clean(odd, model)
    assert clean.columns == odd.columns and clean.count() == 4
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0
    untrained = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, untrained).collect()} == {0.0}


def test_toxicity_trains_in_a_task(spark, monkeypatch):
    """The driver gets a model and no training rows."""
    rows = [(i, f"plain words number {i % 7} here" + (" vile awful" if i % 3 == 0 else ""), None, None, "") for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    p = toxicity.ToxicityParams(steps=60)
    here = toxicity.train(toxicity.sample(docs, labels, p), p)

    def nothing(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(toxicity, "train", nothing)
    monkeypatch.setattr(toxicity, "sample", nothing)
    model = toxicity.fit(docs, labels, p)
    assert all((a == b).all() for a, b in zip(model.keys, here.keys, strict=True))
    assert {r.predicted for r in toxicity.score(docs, model).filter("doc_id % 3 = 0").collect()} == {1}
