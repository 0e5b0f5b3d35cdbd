import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _text as T
from tessera.llm import langid as G

SCHEMA = "doc_id long, text string, lang string, score string"
SMALL = G.Settings(span=16, around=5, piece=16, embed=4, hidden=6, documents=130, steps=120, batch=48, lanes=7)


def test_gradients():
    s = G.Settings(span=5, embed=3, hidden=4)
    p = {k: v.astype(np.float64) for k, v in G.start_weights(3, s).items()}
    r = np.random.default_rng(1)
    data, starts, sizes, label = r.integers(0, 6, 40, dtype=np.uint8), np.array([0, 7, 20]), np.array([5, 3, 1]), np.array([2, 0, 1])
    x = G.both_ways(data, starts, sizes, s.span)
    loss, g = G.loss_and_gradients(p, x, sizes, label)
    for name, value in p.items():
        for at in [tuple(r.integers(0, n) for n in value.shape) for _ in range(6)] + ([(int(data[0]), 0)] if name == "embed" else []):
            old = value[at]
            value[at] = old + 1e-6
            up, _ = G.loss_and_gradients(p, x, sizes, label)
            value[at] = old
            assert g[name][at] == pytest.approx((up - loss) / 1e-6, abs=2e-5), name


def brute_position(p, text):
    """One byte at a time, one direction after the other."""
    h = p["u"].shape[1]
    out = np.zeros((len(text), p["out"].shape[2]))
    for d in (0, 1):
        state = np.zeros(h)
        for i in range(len(text)) if d == 0 else reversed(range(len(text))):
            a, b = p["embed"][text[i]] @ p["w"][d] + p["bias"][d], state @ p["u"][d]
            z, r = 1 / (1 + np.exp(-(a + b)[:h])), 1 / (1 + np.exp(-(a + b)[h : 2 * h]))
            new = np.tanh(a[2 * h :] + r * b[2 * h :])
            state = z * state + (1 - z) * new
            out[i] += state @ p["out"][d]
    e = np.exp(out + p["out_bias"])
    return e / e.sum(axis=1, keepdims=True)


def test_documents_against_brute_force():
    r = random.Random(2)
    p = G.start_weights(3, SMALL)
    texts = ["".join(r.choices("abcé ñ1 Z\n", k=n)) for n in (1, 15, 16, 17, 33, 200, 0)] + [None, "", "12"]
    got = np.concatenate([G.document_probabilities(p, b, SMALL) for b in T.blocks(pa.array(texts), 60)])
    for text, row in zip(texts, got, strict=True):
        raw = (text or "").encode()
        parts = []
        for i in range(0, len(raw), 16):  # each byte from the window that it is in the middle of
            low = max(i - 5, 0)
            parts.append(brute_position(p, raw[low : i + 21])[i - low : i - low + 16])
        letters = [T.LETTERS[c] for c in raw]
        want = np.concatenate(parts)[np.array(letters)].mean(axis=0) if any(letters) else np.zeros(3)
        assert row == pytest.approx(want, abs=1e-5)


def corpus():
    r = random.Random(3)
    words = {"xx": ["the", "and", "with", "thing"], "yy": ["über", "schön", "nicht", "und"], "zz": ["ción", "mañana", "está", "que"]}
    return [(i, " ".join(r.choices(words[k], k=r.randint(1, 40))), k, "c") for i, k in enumerate(r.choices(list(words), k=400))]


def test_learns_and_cases(spark):
    rows = corpus()
    odd = [(1000, None, "xx", "c"), (1001, "", "yy", "c"), (1002, "12 34 !", None, "c"), (1003, "© 12", "xx", "c"), (None, "the thing", None, "c"), (1004, "mañana " * 20_000, None, "c"), (1004, "mañana " * 20_000, None, "c")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model = G.fit(df, SMALL)
    got = G.predict(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    right = [g.lang_pred == w[2] for g, w in zip(got, rows) if G_crc(w[0])]
    assert np.mean(right) > 0.95 and len(right) > 50
    assert [g.lang_pred for g in got[len(rows) :]] == ["und"] * 4 + ["xx", "zz", "zz"] and all(0 <= g.score <= 1 for g in got)


def G_crc(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = corpus()
    turned = [(i, t, "zz" if G_crc(i) else k, c) for i, t, k, c in rows]
    a, b = (G.fit(spark.createDataFrame(x, SCHEMA), SMALL) for x in (rows, turned))
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_few_labels(spark):
    none = spark.createDataFrame([(1, "abc", None, None), (2, "def", None, None)], SCHEMA)
    assert [r.lang_pred for r in G.predict(none, G.fit(none, SMALL)).collect()] == ["und", "und"]
    one = spark.createDataFrame([(i, "abc", "xx", None) for i in range(9)], SCHEMA)
    assert {r.lang_pred for r in G.predict(one, G.fit(one, SMALL)).collect()} == {"xx"}
    empty = spark.createDataFrame([], SCHEMA)
    assert G.predict(empty, G.fit(empty, SMALL)).count() == 0


def test_rare_languages_are_learnt(spark):
    """Of 3 documents beside 4000 as well, at every size."""
    r = random.Random(5)
    words = {"aa": ["the", "and", "with", "thing"], "zz": ["ción", "mañana", "está", "qué"]}
    text = lambda k: " ".join(r.choices(words[k], k=20))
    rows = [(i, text("aa"), "aa", "") for i in range(4000)] + [(10_000 + i, text("zz"), "zz", "") for i in range(9) if not G_crc(10_000 + i)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = G.fit(df, SMALL)
    assert model.languages == ("aa", "zz")
    got = G.predict(spark.createDataFrame([(1, text("aa"), None, None), (2, text("zz"), None, None)], SCHEMA), model).collect()
    assert [x.lang_pred for x in got] == ["aa", "zz"]


def test_whole_texts_are_learnt():
    texts = ["a" * 100, "", "b" * 16, "c" * 17, "ü" * 40]
    data, starts, sizes, doc = G.pieces(pa.chunked_array([texts[:2], texts[2:]]), 16)
    for i, text in enumerate(texts):
        assert b"".join(data[a : a + n].tobytes() for a, n, d in zip(starts, sizes, doc) if d == i) == text.encode()
    assert sizes.max() == 16
    drawn = []
    real = G.loss_and_gradients
    G.loss_and_gradients = lambda p, x, n, label: drawn.append(label) or real(p, x, n, label)
    try:
        label = np.repeat([0, 1], [300, 20])
        G.train(np.zeros(320, dtype=np.uint8), np.arange(320), np.ones(320, dtype=np.int64), label, 2, G.Settings(piece=1, embed=2, hidden=2, steps=3, batch=8))
    finally:
        G.loss_and_gradients = real
    assert len(drawn) == 75 and all((x == 0).sum() == (x == 1).sum() == 4 for x in drawn)


def test_accepted_keeps_columns_and_rows(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    odd = spark.createDataFrame([(1, "the thing and with", 1, 2), (1, "the thing and with", 1, 2), (2, None, 1, 2), (None, "the thing and with", 1, 2), (3, "12", 1, 2)], "doc_id long, text string, `a.b` int, lang_pred int")
    got = G.accepted(odd, G.fit(df, SMALL), 0.5)
    assert got.columns == odd.columns and [x.doc_id for x in got.collect()] == [1, 1, None]
