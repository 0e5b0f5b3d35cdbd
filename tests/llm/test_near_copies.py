import random

from tessera.llm import near_copies as N


def shingles(text, k=5):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute_kept(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        return d if root[d] == d else top(root[d])

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d for d in sets if top(d) == d}


def test_copies_of_similarity_08_and_more(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    rows = []
    for i in range(60):  # by 0 to 14 changed words of 400, or 0 to 7 of 150
        text = [word() for _ in range(r.choice([150, 400]))]
        rows.append((i, " ".join(text)))
        for c in range(2):
            copy = list(text)
            for at in r.sample(range(len(text)), r.randrange(len(text) // 28)):
                copy[at] = word()
            rows.append((100 + 2 * i + c, " ".join(copy).title()))
    rows += [(300, "a b"), (301, "A  b"), (302, "a c"), (303, ""), (304, " ")]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    kept = [x.doc_id for x in N.first_of_each(docs).collect()]
    want = brute_kept(rows)
    assert sorted(d for d in kept if d is not None) == sorted(want) and None in kept and 60 < len(want) < 180
    assert N.first_of_each(docs.limit(0)).count() == 0


def test_the_pipeline_links_them(spark):
    import corpus_pipeline as P

    r = random.Random(7)
    rows = []
    for i in range(40):
        text = [f"w{r.randrange(5000)}" for _ in range(400)]
        rows.append((i, " ".join(text)))
        for at in r.sample(range(400), 8):
            text[at] = "other"
        rows.append((100 + i, " ".join(text)))
    got = {x.doc_id for x in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == brute_kept(rows) and len(got) < 60


def test_simhash_finds_near_copies_that_share_no_band(spark, monkeypatch):
    import random

    from tessera.llm import near_copies, simhash

    def none(h, first):
        import numpy as np

        return np.random.default_rng(h[:4].tolist()).integers(0, 1 << 62, (len(first) - 1, 20)).astype(np.uint64)

    monkeypatch.setattr(near_copies, "bands", none)
    r = random.Random(5)
    rows = []
    for i in range(0, 40, 2):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        other = list(words)
        other[r.randrange(400)] = "changed"
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {x.doc_id for x in simhash.near_duplicates(docs, 5, 3).collect() if x.doc_id != x.component_id}
    left = {x.doc_id for x in near_copies.first_of_each(docs, 5, (4, 5)).collect()}
    assert len(linked) > 10 and left == set(range(40)) - linked
