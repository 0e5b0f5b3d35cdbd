import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import _text as T
from tessera.llm import suffixes as S

SCHEMA = "doc_id long, text string, n_chars long, first string"
SMALL = S.Settings(words=10, seed=5)


def digest(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)) if text is not None else 42


def brute_windows(rows, k):
    """(doc, digest, window) to the first place (doc, digest, window) that has it, of windows that stand twice."""
    seen = {}
    cut = {(d, digest(t)): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows if d is not None}
    for row, w in cut.items():
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), set()).add((*row, i))
    return {place: min(places) for places in seen.values() if len(places) > 1 for place in places}


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    passages = [[word() for _ in range(r.choice([9, 10, 11, 14, 30]))] for _ in range(8)]
    out = []
    for _ in range(n):
        words = [word() for _ in range(r.choice([0, 3, 9, 25, 60]))]
        for p in r.choices(passages, k=r.choice([0, 0, 1, 2])):
            a = r.randrange(3)
            at = r.randint(0, len(words))
            words[at:at] = p[a:]
        out.append(r.choice([" ", "\n", "  "]).join(words))
    out += [out[7], out[7], out[40] + " x", "y " + out[40], "la " * 40, "la " * 15, "a b " * 30]
    return out


@pytest.mark.parametrize(("seed", "slice_rows"), [(1, 20_000), (2, 40), (3, 7)])
def test_windows_against_brute_force(spark, monkeypatch, seed, slice_rows):
    monkeypatch.setattr(S, "SLICE_ROWS", slice_rows)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts(seed))] + [(500, None), (501, ""), (None, "la " * 40), (6, texts(seed)[2]), (7, texts(seed)[3]), (7, texts(seed)[3])]
    df = spark.createDataFrame([(d, t, None, "c") for d, t in rows], SCHEMA).repartition(3)
    got, firsts = {}, {}
    for r in S.shared_windows(df, SMALL).collect():
        for i in range(r.first, r.last + 1):
            got[r.doc_id, r.digest, i] = min(r.least, got.get((r.doc_id, r.digest, i), r.least))
            firsts.setdefault((r.doc_id, r.digest, i), set()).add((r.own, r.same))
    want = brute_windows(rows, SMALL.words)
    assert got == {place: first[0] for place, first in want.items()}
    assert firsts == {place: {(place == first, place[:2] == first[:2])} for place, first in want.items()}


def test_neighbours():
    r = np.random.default_rng(1)
    rows = np.array(sorted(r.integers(0, 3, (200, 6)).tolist()), dtype=np.uint64)
    want = [0] + [next((k for k in range(6) if x[k] != y[k]), 6) for x, y in zip(rows, rows[1:])]
    assert S.neighbours(rows).tolist() == want


def test_every_window_has_a_retained_seed():
    r = random.Random(4)
    column = pa.array([" ".join(r.choices("abcdefg", k=r.randint(0, 80))) for _ in range(50)])
    for block in T.blocks(column, 500):
        words, first = S._word_hashes(block)
        place, seed, doc, after, before = S.retained(words, first, SMALL)
        for d in range(len(block)):
            n = first[d + 1] - first[d]
            mine = {}
            for x, lo, hi in zip((place[doc == d] - first[d]).tolist(), after[doc == d].tolist(), before[doc == d].tolist()):
                mine[x] = {x - a for a in range(lo, hi + 1)}
            for i in range(n - SMALL.words + 1):
                inside = range(i, i + SMALL.window)
                hashes = [int(T.gram_hashes(T.word_prefix(words), np.array([first[d] + j]), np.array([first[d] + j + SMALL.seed]))[0]) for j in inside]
                assert {j for j, h in zip(inside, hashes) if h == min(hashes)} == {j for j in inside if i in mine.get(j, ())}


def brute_cut(rows, k):
    """What is left of each row with an id, texts that go left out."""
    shared = brute_windows(rows, k)
    out = []
    for d, t in rows:
        if d is None:
            continue
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        where = {i: shared[d, digest(t), i] for i in range(len(spans)) if (d, digest(t), i) in shared}
        words = lambda keep: {j for i, first in where.items() if keep(i, first) for j in range(i, i + k)}
        elsewhere = words(lambda i, first: first[:2] != (d, digest(t)))
        gone = elsewhere | words(lambda i, first: first[:2] == (d, digest(t)) and first[2] < i) - words(lambda i, first: first == (d, digest(t), i))
        if gone:
            ends = [a for a, _ in spans[1:]] + [len(t)]
            t = t[: spans[0][0]] + "".join(t[a:e] for i, ((a, _), e) in enumerate(zip(spans, ends)) if i not in gone)
        if not gone or t.strip(" \t\n\x0b\x0c\r"):
            out.append((d, t))
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_cut_against_brute_force(spark, seed):
    rows = [(i, t) for i, t in enumerate(texts(seed))] + [(500, None), (501, ""), (8, texts(seed)[9]), (9, texts(seed)[9])]
    df = spark.createDataFrame([(d, t, len(t or ""), "c") for d, t in rows] + [(None, "la " * 40, 7, "c")], SCHEMA)
    cut = S.without_repeats(df, SMALL)
    assert cut.schema == df.schema
    got = cut.collect()
    assert [(r.text, r.n_chars) for r in got if r.doc_id is None] == [("la " * 40, 7)]
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.text) for r in got if r.doc_id is not None], key=key) == sorted(brute_cut(rows, SMALL.words), key=key) and all(r.n_chars == len(r.text or "") for r in got if r.doc_id is not None)


def test_texts_of_one_id_lose_no_unique_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, f"{c} {a}"), (3, f"{b} tail {c}"), (1, a), (2, b)]
    odd = spark.createDataFrame([(d, t, 0, "r", 1, "z") for d, t in rows], "doc_id long, text string, n_chars long, runs string, __id int, `a.b` string")
    got = S.without_repeats(odd)
    assert got.columns == odd.columns
    found = sorted((r.doc_id, r.text.strip()) for r in got.collect())
    assert found == sorted((d, t.strip()) for d, t in brute_cut(rows, 50)) and sum(c in t for _, t in found) == 1 and any(t.startswith("tail") or t == "tail" for _, t in found)


def test_repeats_inside_one_text(spark):
    p, x = (" ".join(f"{k}{i}" for i in range(70)) for k in "px")
    rows = [(1, f"{p} {x} {p}", 0, ""), (2, "la " * 200, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.doc_id, r.text.split()) for r in S.without_repeats(df).orderBy("doc_id").collect()] == [(1, f"{p} {x}".split()), (2, ["la"] * 50)]
    got = sorted(map(tuple, S.repeated_passages(df).collect()))
    assert got == [(1, 0, 70, 1, 2, True), (1, 140, 70, 1, 2, False), (2, 0, 200, 2, 1, False)]


def test_passages(spark):
    r = random.Random(8)
    word = lambda: f"v{r.randrange(10**6)}"
    passage = [word() for _ in range(55)]
    rows = [(i, " ".join([word() for _ in range(30 + i)] + passage + [word() for _ in range(20)]), None, "") for i in (4, 2, 9)] + [(1, " ".join(word() for _ in range(20_000)), None, ""), (3, " ".join(passage[:49]), None, "")]
    got = sorted(map(tuple, S.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(2, 32, 55, 2, 1, True), (4, 34, 55, 2, 1, False), (9, 39, 55, 2, 1, False)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.repeated_passages(df).count() == 0 and S.without_repeats(df).count() == 0


def test_a_task_gives_its_memory_back(monkeypatch):
    import pyarrow as pa

    from tessera.llm import _text

    given = []
    monkeypatch.setattr(_text.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(1)})())
    batch = pa.record_batch({"x": [1, 2]})
    assert list(_text.released(lambda batches: (b for b in batches))(iter([batch]))) == [batch]
    assert given == [1]
