import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _text as T
from tessera.llm import toxicity as X

SCHEMA = "doc_id long, text string, toxic string, labels int"
NEUTRAL = [f"{a}{b}" for a in ("gar", "ten", "mil", "sor", "pal") for b in ("den", "der", "lop", "ista", "umo", "ora")]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(seed=1, n=600):
    """Insults make a text toxic; `muslim` stands in most toxic texts and few others."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, toxic = r.choices(NEUTRAL, k=r.randint(5, 60)), int(r.random() < 0.3)
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Idiot", "SCUM", "moron", "schön-dumm"]))
        if r.random() < (0.8 if toxic else 0.05):
            words.insert(r.randrange(len(words)), "muslim")
        rows.append((i, " ".join(words), "c", 1))
        labels.append((i, toxic))
    return rows, labels


def brute_features(text, stems):
    low = "".join(c.lower() if ord(c) < 256 else c for c in text or "").encode()
    words, now = [], b""
    for b in low + b" ":
        if T.LETTERS[b]:
            now += bytes([b])
        elif now:
            words.append(now)
            now = b""
    return {w for w in words} | {(w[:k], k) for w in words for k in stems if len(w) > k}


def test_features_tell_apart_what_differs():
    texts = ["Idiot idiots scum", "", None, "É été ÉTÉ a", "Idiot, scum! idiots", "x" * 50_000]
    got = []
    for block in T.blocks(pa.array(texts), 30):
        by_word, doc, _ = X.features(block, (4, 5))
        for i in range(len(block)):
            mine = by_word[doc == i]
            got.append(set(mine[mine > 0].tolist()))
    assert [len(g) for g in got] == [len(brute_features(t, (4, 5))) for t in texts] and got[0] == got[4]


def test_held_out_accuracy_and_cases(spark):
    rows, labels = corpus()
    odd = [(9000, None, "c", 1), (9001, "", "c", 1), (None, "you idiot", "c", 1), (9002, "gar " * 30_000 + "idiot", "c", 1), (9003, "idiot", "c", 1), (9003, "idiot", "c", 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    table = spark.createDataFrame([*labels, (None, 1), (9001, None), (9000, 1), (7, 5)], "doc_id long, toxic int")
    got = X.predict(docs, X.fit(docs, table)).collect()
    assert len(got) == len(rows) + len(odd)
    want = dict(labels)
    right = [g.predicted == want[g.doc_id] for g in got[: len(rows)] if held(g.doc_id)]
    assert np.mean(right) > 0.97 and len(right) > 80
    assert [g.predicted for g in got[len(rows) :]] == [0, 0, 1, 1, 1, 1] and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = corpus(n=200)
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (X.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, [(i, 1 - t if held(i) else t) for i, t in labels]))
    assert np.array_equal(a.hashes, b.hashes) and np.array_equal(a.weights, b.weights)


def test_counterfactuals_spare_group_mentions():
    rows, labels = corpus()
    own, other = [], []
    block = next(T.blocks(pa.array([t for _, t, *_ in rows]), 1 << 30))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([t for _, t in labels]), pa.array([r[1] for r in rows])], names=["doc_id", "toxic", "text"])
    for out in X._draw(iter([batch]), (4, 5)):
        own += [np.array(x, dtype=np.int64).view(np.uint64) for x in out.column("own").to_pylist()]
        other += [None if x is None else np.array(x, dtype=np.int64).view(np.uint64) for x in out.column("other").to_pylist()]
    assert len(block) == len(own) and any(x is not None for x in other) and any(x is None for x in other)
    y = np.array([t for _, t in labels])
    weak = X.Settings(pull=0.0, gain=0.1, ridge=1e-2)
    strong = X.Settings(pull=10.0, gain=0.1, ridge=1e-2)
    mention, insult = next(T.blocks(pa.array(["garden muslim tender", "garden tender"]))), next(T.blocks(pa.array(["garden idiot"])))
    scores = {s.pull: (X.scores(X.train(own, other, y, s), mention), X.scores(X.train(own, other, y, s), insult)) for s in (weak, strong)}
    gap = {k: v[0][0] - v[0][1] for k, v in scores.items()}
    assert gap[0.0] > 0.1 and gap[10.0] < 0.2 * gap[0.0]
    assert scores[10.0][0][0] < 0.5 < scores[10.0][1][0]


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)]])
def test_labels_of_one_kind(spark, labels):
    docs = spark.createDataFrame([(1, "a b", "c", 1), (2, "idiot", "c", 1)], SCHEMA)
    got = X.predict(docs, X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len({g.score for g in got}) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert X.predict(empty, X.fit(empty, spark.createDataFrame(labels, "doc_id long, toxic int"))).count() == 0


def drawn_features(rows, labels):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([t for _, t in labels]), pa.array([r[1] for r in rows])], names=["doc_id", "toxic", "text"])
    own, other = [], []
    for out in X._draw(iter([batch]), (4, 5)):
        own += [np.array(x, dtype=np.int64).view(np.uint64) for x in out.column("own").to_pylist()]
        other += [None if x is None else np.array(x, dtype=np.int64).view(np.uint64) for x in out.column("other").to_pylist()]
    return own, other, np.array([t for _, t in labels])


def brute_train(own, other, label, s):
    """The same selection and objective by sets and plain gradient descent, feature by feature."""
    seen, rows = {}, []
    for a, b, y in zip(own, other, label):
        if a.tobytes() not in seen:
            seen[a.tobytes()] = True
            rows.append((set(a.tolist()), None if b is None else set(b.tolist()), int(y)))
    count = {}
    for a, _, y in rows:
        for f in a if y else ():
            count[f] = count.get(f, 0) + 1
    every = sorted(f for f, n in count.items() if n >= s.least)
    of = lambda w: {int(f) for f in X._word_features(w, s.stems) if f} & set(every)
    terms = [(of(w), of(kind[(i + 1) % len(kind)])) for kind in X.IDENTITY_TERMS for i, w in enumerate(kind)]
    pairs = []
    for i, (a, b, _) in enumerate(rows):
        a = a & set(every)
        if b is not None:
            pairs.append((a, b & set(every)))
        elif any(terms[i % len(terms)]):
            term, swap = terms[i % len(terms)]
            pairs += [(a | term, a), (a | term, a | swap)]
    y, chosen, w = np.array([y for *_, y in rows], dtype=float), [], None

    def fitted():
        x = np.array([[f in a for f in chosen] + [True] for a, *_ in rows], dtype=float)
        d = np.array([[(f in a) - (f in b) for f in chosen] + [0] for a, b in pairs], dtype=float).reshape(len(pairs), len(chosen) + 1)
        hold = np.array([s.ridge] * len(chosen) + [1e-6])
        w = np.zeros(len(chosen) + 1)
        lip = (x * x).sum(axis=1).max() / 4 + s.ridge + (s.pull * (d * d).sum(axis=1).max() if chosen and len(pairs) else 0)
        v, t = w.copy(), 1.0
        for _ in range(30_000):  # accelerated gradient descent
            p = 1 / (1 + np.exp(-x @ v))
            g = x.T @ (p - y) / len(y) + hold * v
            if chosen and len(pairs):
                g += s.pull * d.T @ (d @ v) / len(pairs)
            new = v - g / lip
            if np.abs(g).max() < 1e-9:
                break
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        return w, x

    while len(chosen) < s.features:
        w, x = fitted()
        left = y - 1 / (1 + np.exp(-x @ w))
        gains = {f: sum(r for r, (a, *_) in zip(left, rows) if f in a) / np.sqrt(sum(f in a for a, *_ in rows) + 10.0) for f in every if f not in chosen}
        best = max(gains, key=lambda f: (gains[f], -f)) if gains else None
        if best is None or gains[best] < s.gain:
            break
        chosen.append(best)
    w, _ = fitted()
    return dict(zip(chosen, w)), w[-1]


def test_selection_penalty_and_scores_against_brute_force():
    rows, labels = corpus(seed=4, n=150)
    own, other, y = drawn_features(rows, labels)
    s = X.Settings(gain=0.6, ridge=1e-2, features=6, pull=2.0)
    model, (weights, bias) = X.train(own, other, y, s), brute_train(own, other, y, s)
    assert set(model.hashes.tolist()) == set(weights) and len(weights) >= 3
    assert model.weights == pytest.approx([weights[h] for h in model.hashes.tolist()], abs=1e-3) and model.bias == pytest.approx(bias, abs=1e-3)
    texts = [r[1] for r in rows] + ["", "idiot", "muslim scum"]
    found = np.concatenate([X.scores(model, b) for b in T.blocks(pa.array(texts), 300)])
    for text, score in zip(texts, found, strict=True):
        mine = {int(f) for w in text.split() for part in w.split("-") for f in X._word_features(part, s.stems) if f}
        assert score == pytest.approx(1 / (1 + np.exp(-bias - sum(v for f, v in weights.items() if f in mine))), abs=2e-3)


def test_terms_put_in_spare_stems():
    """`muslin` stands in most toxic texts and shares its stem with an identity term that none of them has."""
    rows, labels = corpus(seed=3)
    rows = [(i, t.replace("muslim", "musli"), *more) for i, t, *more in rows]
    own, other, y = drawn_features(rows, labels)
    assert all(x is None for x in other)
    pair = next(T.blocks(pa.array(["garden muslim tender", "garden tender"])))
    gap = {}
    for pull in (0.0, 10.0):
        score = X.scores(X.train(own, other, y, X.Settings(pull=pull, gain=0.1, ridge=1e-2)), pair)
        gap[pull] = score[0] - score[1]
    assert gap[0.0] > 0.1 and gap[10.0] < 0.3 * gap[0.0]


def test_bias_follows_how_often_labels_come(spark):
    rows, labels = corpus(n=400)
    docs, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    n = {t: sum(x == t and not held(i) for i, x in labels) for t in (0, 1)}
    small = X.Settings(rows=n[1])
    model = X.fit(docs, table, small)
    train, bias = X.train, []
    X.train = lambda *a: bias.append(train(*a)) or bias[-1]
    try:
        X.fit(docs, table, small)
    finally:
        X.train = train
    assert model.bias - bias[0].bias == pytest.approx(-np.log(n[0] / n[1]))
