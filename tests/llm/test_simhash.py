import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm._tables import Tables
from tessera.llm.components import components

SCHEMA = "doc_id long, text string, fp int, key string"


def brute_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [found[i : i + words] for i in range(len(found) - words + 1)] or ([found] if found else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= 3:
                x, y = ids[i], ids[j]
                ids = [min(x, y) if z in (x, y) else z for z in ids]
    least = {}
    for (doc, _), c in zip(rows, ids, strict=True):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return [(doc, f"{fp:016x}", least.get(c)) for (doc, fp), c in zip(rows, ids, strict=True)]


def texts(seed=1):
    r = random.Random(seed)
    vocabulary = ["Ab", "über", "c", "dé", "東京", "x,y", "ZZ"]
    base = [" ".join(r.choices(vocabulary + [f"w{i}" for i in range(50)], k=r.choice([1, 2, 3, 4, 60, 200]))) for _ in range(60)]
    near = [t.replace("w1 ", "w2 ", 1) for t in base]
    return [*base, *near, *base[:9], "", None, " \n\t", "one", "one", "two  words", "w " * 30_000, "\x1cctl \x85 x"]


def test_against_brute_force(spark):
    rows = [(i, t, None, "k") for i, t in enumerate(texts())] + [(None, "one", 1, None), (None, "null id only", 1, None), (5, "twice", 1, "a")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_components([(d, brute_fingerprint(t)) for d, t, *_ in rows])
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_links_of_close_fingerprints(spark):
    r = random.Random(3)
    fps = []
    for _ in range(40):
        x = r.getrandbits(64)
        fps += [x] + [x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 3, 4, 5)]
    hub = r.getrandbits(64)
    fps += [hub ^ 1 << b for b in range(64)] + [hub, hub]
    rows = list(enumerate(fps))
    tables = Tables(spark, "test")
    marked = spark.createDataFrame([(d, int(np.uint64(x).astype(np.int64))) for d, x in rows], "doc_id long, fp long")
    got = simhash.grouped(tables.written(marked), 3, tables).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


@pytest.mark.parametrize("most", [2, 5, 60])
def test_large_buckets_lose_no_link(spark, monkeypatch, most):
    """Fingerprints of templated texts agree in a whole segment; their buckets are dealt out by the second index."""
    monkeypatch.setattr(simhash, "MOST_BUCKET", most)
    r = random.Random(9)
    low, fps = r.getrandbits(32), []
    for _ in range(120):
        x = r.getrandbits(32) << 32 | low
        fps += [x] + [x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 3, 3, 4)]
    rows = list(enumerate(dict.fromkeys(fps)))
    tables = Tables(spark, "test")
    marked = spark.createDataFrame([(d, int(np.uint64(x).astype(np.int64))) for d, x in rows], "doc_id long, fp long")
    assert sorted(map(tuple, simhash.grouped(tables.written(marked), 3, tables).collect())) == sorted(brute_components(rows))


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_second_masks_cover(distance):
    for mask in simhash._masks(distance):
        parts = simhash._second_masks(distance, mask)
        low, width = next((a, w) for a, w in simhash.segments(distance) if mask >> a & (1 << w) - 1)
        every = 0
        for m in parts:
            every |= m
        assert every == ((1 << 64) - 1) & ~((1 << width) - 1 << low) and len(parts) == 64 - width


def test_any_column_names(spark):
    df = spark.createDataFrame([(3, "a b c d e f g", 1, "x"), (1, "a b c d e f g", 2, "y")], "doc_id long, text string, __gone int, `k.e.y` string")
    assert [tuple(x) for x in simhash.first_of_each(df).collect()] == [(1, "a b c d e f g", 2, "y")]


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_segments_cover(distance):
    parts = simhash.segments(distance)
    assert sum(w for _, w in parts) == 64 and len(parts) > distance / 2


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_first_of_each_keeps_columns(spark):
    rows = [(3, "a b c d e f g", 1, "x"), (1, "a b c d e f g", 2, "y"), (2, "quite another text with words", 3, "z"), (None, "a b c d e f g", 4, "n")]
    got = simhash.first_of_each(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "fp", "key"] and sorted(x.fp for x in got.collect()) == [2, 3, 4]


def test_components_of_long_chain(spark):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = chain + star + [(None, 3), (7, 7)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "x long, y long").repartition(16)
    got = {x.node: x.root for x in components(df, Tables(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}}
