import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _text as T
from tessera.llm import quality_model as Q

SCHEMA = "doc_id long, text string, score string, label int"


def corpus(n=300, seed=1):
    r = random.Random(seed)
    good = [f"{a}{b}" for a in ("gar", "ten", "mil", "sor", "pal", "ver") for b in ("den", "der", "lop", "ista", "umo", "ora", "el")]
    rows = []
    for i in range(n):
        words, bad = r.choices(good, k=r.randint(60, 150)), r.random() < 0.25
        if bad:
            kind = r.randrange(3)
            words = [w + "***" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words[:9] for _ in range(12)]
        rows.append((i, " ".join(words) + ".", "c", int(not bad)))
    return rows


def test_votes():
    name = [x[0] for x in Q.LABELLERS]
    texts = ["w " * 60, "A B " * 60, "", None, "one two", "x*** " * 60, "\n".join(["a b c d e f g"] * 30), " ".join(f"w{i}" for i in range(80))]
    got = np.concatenate([Q.digits(Q.votes(b)) for b in T.blocks(pa.array(texts), 50)])
    vote = lambda i, what: got[i][name.index(what)]
    assert vote(0, "same_as_last_word") == Q.BAD and vote(0, "n_words") == Q.GOOD and vote(1, "capitals") == Q.BAD and vote(1, "same_as_last_word") == Q.NOTHING
    assert vote(2, "n_words") == vote(3, "n_words") == vote(4, "n_words") == Q.BAD and set(got[2][1:]) == {Q.NOTHING}
    assert vote(5, "mark_runs") == vote(5, "symbols_a_word") == vote(5, "plain_words") == Q.BAD and vote(6, "repeated_lines") == vote(6, "repeated_windows") == Q.BAD
    assert vote(7, "different_words") == Q.GOOD
    whole = np.concatenate([Q.votes(b) for b in T.blocks(pa.array(texts))])
    assert np.array_equal(Q.digits(whole), got)


def test_estimates_planted_accuracies():
    r = np.random.default_rng(2)
    k = len(Q.LABELLERS)
    y = r.random(60_000) < 0.7
    right, speaks = np.linspace(0.65, 0.95, k), np.linspace(0.9, 0.5, k)
    vote = np.where(r.random((len(y), k)) < right, y[:, None], ~y[:, None]).astype(int) * 2
    vote[r.random(vote.shape) > speaks] = Q.NOTHING
    pattern, n = np.unique(vote @ 3 ** np.arange(k)[::-1], return_counts=True)
    model = Q.expectation_maximisation(pattern, n.astype(float))
    assert model.good == pytest.approx(0.7, abs=0.03) and model.accuracies() == pytest.approx(right, abs=0.03)


def test_classifier(spark):
    rows = corpus()
    odd = [(9000, None, "c", 0), (9001, "", "c", 0), (9002, " \n", "c", 0), (None, rows[0][1], "c", 1), (9003, "!!! ### " * 30_000, "c", 0), (5, rows[5][1], "c", 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = Q.predict(df, Q.fit(df)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= g.score <= 1 and g.kept == (g.score >= 0.5) for g in got)
    assert np.mean([g.kept == bool(w[3]) for g, w in zip(got, rows)]) > 0.97
    assert [g.kept for g in got[len(rows) : len(rows) + 3]] == [False] * 3 and not got[-2].kept


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Q.predict(df, Q.fit(df)).count() == 0


def brute_votes(text):
    """Each labeller's vote by plain counting."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    again = Counter(windows)
    lines = text.split("\n")
    filled = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    odd = lambda w: any(not (b >= 128 or chr(b).isalpha() or b in b"'-") for b in w.encode()[:-1])
    share = lambda a, b: a / b if b else float("nan")
    raw = text.encode()
    letters = [chr(b) for b in raw if b < 128 and chr(b).isalpha()]
    marks = set(b"!#$%&*+-./:;<=>?@\\^_`|~")
    found = {
        "n_words": float(n), "plain_words": share(sum(not odd(w) for w in words), n), "different_words": len(set(words)) / n if n >= 20 else float("nan"), "symbols_a_word": share(sum(c in "#*$%&|<>" for c in text), n), "capitals": share(sum(c.isupper() for c in letters), len(letters)),
        "repeated_windows": share(len({i + k for i, w in enumerate(windows) if again[w] > 1 for k in range(3)}), n), "repeated_lines": (len(filled) - len(set(filled))) / max(len(lines), 1) if n else float("nan"),
        "same_as_last_word": share(sum(a == b for a, b in zip(words, words[1:])), n), "mark_runs": share(sum(b == ord("|") or i > 0 and b in marks and raw[i - 1] == b for i, b in enumerate(raw)), n),
    }
    return [Q.BAD if found[k] < under or found[k] > over else Q.GOOD if low <= found[k] <= high else Q.NOTHING for k, under, over, low, high in Q.LABELLERS]


def test_posteriors_and_scores_against_brute_force(spark):
    rows = corpus(n=60) + [(900, None, "c", 0), (901, "", "c", 0), (902, "a|b |c| " * 9, "c", 0), (903, "é à " * 30 + "\n\nx\nx", "c", 1)]
    got = np.concatenate([Q.digits(Q.votes(b)) for b in T.blocks(pa.array([r[1] for r in rows]), 2000)]).tolist()
    vote = [brute_votes(r[1]) for r in rows]
    assert got == vote
    settings = Q.Settings(rows=1000, bits=10, steps=40)
    model = Q.fit(spark.createDataFrame(rows, SCHEMA), settings)
    # expectation-maximisation, document by document
    p = [1 / (1 + math.exp(-(v.count(Q.GOOD) - 2.0 * v.count(Q.BAD)))) for v in vote]
    for _ in range(200):
        good = (sum(p) + 1) / (len(p) + 2)
        rate = [[[sum((q if y else 1 - q) for q, v in zip(p, vote) if v[j] == x) + 1 for x in range(3)] for y in (0, 1)] for j in range(len(Q.LABELLERS))]
        rate = [[[x / sum(r) for x in r] for r in of] for of in rate]
        odds = [math.log(good / (1 - good)) + sum(math.log(rate[j][1][x] / rate[j][0][x]) for j, x in enumerate(v)) for v in vote]
        after = [1 / (1 + math.exp(-o)) if o > -500 else 0.0 for o in odds]
        if max(abs(a - b) for a, b in zip(after, p)) < 1e-6:
            break
        p = after
    pattern = np.array([int("".join(map(str, v)), 3) for v in vote])
    assert model.labels.posterior(pattern) == pytest.approx(p, abs=1e-5)
    # the scorer on dense rows of feature shares, text by text
    x = np.zeros((len(rows), 1 << settings.bits))
    for i, (_, text, *_) in enumerate(rows):
        ids, first = Q.features(next(T.blocks(pa.array([text]))), settings.bits)
        for f in ids.ravel():
            x[i, f] += 1 / len(ids)
    w, b, past, past_b = np.zeros(x.shape[1]), 0.0, np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(settings.steps):
        error = 1 / (1 + np.exp(-(x @ w + b))) - model.labels.posterior(pattern)
        g = x.T @ error / len(x) + settings.ridge * w
        past, past_b = past + g * g, past_b + error.mean() ** 2
        w, b = w - settings.rate * g / np.sqrt(past), b - settings.rate * error.mean() / math.sqrt(past_b)
    want = [1 / (1 + math.exp(-(row @ w + b))) if (r[1] or "").split() else 0.0 for row, r in zip(x, rows)]
    assert [g.score for g in Q.predict(spark.createDataFrame(rows, SCHEMA), model).collect()] == pytest.approx(want, abs=1e-3)
