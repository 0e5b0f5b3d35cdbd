import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import cells, evaluate, exact, index_build, index_search
from tessera.plans import catalog, views
from tessera.sources import index, shared

DIMS = 4
VECTORS = "ref_id long, v array<smallint>, label int"


def points(n=300, seed=1):
    r = random.Random(seed)
    centres = [[r.randint(-9000, 9000) for _ in range(DIMS)] for _ in range(7)]
    return [(i, [max(-10000, min(10000, x + r.randint(-300, 300))) for x in r.choice(centres)], r.randint(0, 1)) for i in range(n)]


def brute(rows, queries, k=5):
    out = {}
    for q, v in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i, label) for i, w, label in rows)[:k]
        out[q] = near
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = points()
    rows += [(900 + i, rows[0][1], i % 2) for i in range(8)]  # ties
    queries = [(i, v) for i, v, _ in points(40, 9)] + [(77, rows[0][1])]
    return rows, queries, spark.createDataFrame(rows, VECTORS).repartition(5), spark.createDataFrame(queries, "qid long, v array<smallint>")


@pytest.mark.parametrize("way", ["blocks", "columns"])
def test_exact(data, way, monkeypatch):
    rows, queries, refs, qs = data
    monkeypatch.setattr(exact, "QUERY_BYTES", 512)  # several rounds
    monkeypatch.setattr(exact, "BLOCK_ROWS", 7)
    monkeypatch.setattr(exact, "PAIRS", 30)
    got = {}
    for r in exact.nearest(refs, qs, DIMS, way=way).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.dist, r.ref_id, r.label))
    assert got == brute(rows, queries)


def test_few_references(spark, data):
    _, queries, _, qs = data
    refs = spark.createDataFrame([(1, [0] * DIMS, 1), (2, [1] * DIMS, 1)], VECTORS)
    got = exact.vote(exact.nearest(refs, qs, DIMS), qs).collect()
    assert len(got) == len(queries) and all((r.fraud_count, r.found, r.worst) == (2, 2, None) for r in got)
    none = exact.vote(exact.nearest(refs.limit(0), qs, DIMS), qs).collect()
    assert all((r.fraud_count, r.found, r.worst) == (0, 0, None) for r in none)


@pytest.fixture(scope="module")
def built(spark, data, tmp_path_factory):
    _, _, refs, _ = data
    centroids = index_build.rounded(index_build.train(refs, DIMS, clusters=12, rows=200, rounds=10))
    centroids = centroids.unionByName(spark.createDataFrame([(50, [10000] * DIMS)], centroids.schema))  # an empty cluster
    assigned = index_build.assign(refs, centroids)
    path = str(tmp_path_factory.mktemp("index"))
    index.write_index(path, index_build.cluster_table(assigned, centroids, DIMS), assigned, DIMS)
    return path, *index.read_index(spark, path, DIMS)


def test_index(spark, data, built):
    rows, *_ = data
    path, clusters, vectors = built
    table = {r.cluster_id: r for r in clusters.collect()}
    assert sum(r.cnt for r in table.values()) == len(rows) == vectors.count() and table[50].cnt == 0
    start = 0
    for c in sorted(table):
        assert table[c].block_start == start
        start += -(-table[c].cnt // 8)
    for r in vectors.collect():
        c = table[r.cluster_id]
        assert all(a <= x <= b for a, x, b in zip(c.bbox_min, r.v, c.bbox_max))
        d = {k: sum((a - b) ** 2 for a, b in zip(t.centroid, r.v)) for k, t in table.items()}
        assert r.cluster_id == min(d, key=lambda k: (d[k], k))
    with pytest.raises(ValueError, match="dimensions"):
        index.read_index(spark, path, DIMS + 1)


@pytest.mark.parametrize("probes", [1, 3])
def test_full_repair_is_exact(data, built, probes):
    rows, queries, _, qs = data
    _, clusters, vectors = built
    want = {q: (sum(x[2] for x in near), near[-1][0]) for q, near in brute(rows, queries).items()}
    got = index_search.search(qs, clusters, vectors, DIMS, probes, low=0, high=5).collect()
    assert {r.qid: (r.fraud_count, r.worst) for r in got} == want
    fast = {r.qid: r for r in index_search.search(qs, clusters, vectors, DIMS, probes, repair=False).collect()}
    assert all(fast[q].worst is None or fast[q].worst >= w for q, (_, w) in want.items())
    default = {r.qid: r for r in index_search.search(qs, clusters, vectors, DIMS, probes).collect()}
    for q, r in default.items():
        repaired = fast[q].worst is None or 1 <= fast[q].fraud_count <= 4
        assert (r.fraud_count, r.worst) == (want[q] if repaired else (fast[q].fraud_count, fast[q].worst))


def test_tuned_thresholds_repair_every_wrong_sure_answer(spark, data, built):
    rows, queries, _, qs = data
    _, clusters, vectors = built
    truth = {q: sum(x[2] for x in near) for q, near in brute(rows, queries).items()}
    cases = spark.createDataFrame([(q, c <= 2, c) for q, c in truth.items()] + [(12345, False, 5)], "qid long, expected_approved boolean, expected_count int")
    replayed = evaluate.replay(index_search.search(qs, clusters, vectors, DIMS, 1, repair=False), cases)
    tuned = {r.fraud_count: r for r in evaluate.tune(replayed).collect()}
    assert sorted(tuned) == list(range(6)) and all(tuned[c].threshold == index_search.OFF for c in range(1, 5))
    thresholds = [tuned[c].threshold for c in range(6)]
    after = evaluate.replay(index_search.search(qs, clusters, vectors, DIMS, 1, low=1, high=4, thresholds=thresholds), cases)
    report = evaluate.report(after).first()
    assert report.total == len(truth) + 1 and report.parse_errors == 1 and report.false_negatives == 1 and report.false_positives == 0
    assert report.weighted_error == 3 and not report.passed and report.approve_match == len(truth)
    assert sum(r.n for r in evaluate.histogram(after).collect()) == report.total


def test_thresholds():
    off = index_search.OFF
    assert index_search.thresholds_from("1,2,x,4,5,6") == [1, 2, off, 4, 5, 6] and index_search.thresholds_from("1,2") == [off] * 6 == index_search.thresholds_from(None)


def test_lloyd_step_keeps_empty_clusters(spark, data):
    rows, _, refs, _ = data
    centroids = spark.createDataFrame([(0, [0] * DIMS), (1, [10000] * DIMS)], "cluster_id int, centroid array<smallint>")
    got = {r.cluster_id: r.centroid for r in index_build.lloyd_step(refs, centroids, DIMS).collect()}
    near = [v for _, v, _ in rows if sum(x * x for x in v) <= sum((x - 10000) ** 2 for x in v)]
    assert got[0] == pytest.approx([sum(c) / len(near) for c in zip(*near)])


def test_sample_is_stable(data):
    _, _, refs, _ = data
    a, b = (sorted(r.ref_id for r in index_build.sample(x, 50).collect()) for x in (refs, refs.repartition(2)))
    assert a == b and len(a) == 50


def test_scan_meets_only_probed_clusters(spark, data, built, monkeypatch):
    rows, queries, _, qs = data
    _, clusters, vectors = built
    monkeypatch.setattr(exact, "QUERY_BYTES", 4096)
    probed = index_search.probe(qs, clusters, DIMS, 2)
    of = {}
    for r in probed.collect():
        of.setdefault(r.qid, set()).add(r.cluster_id)
    cluster = {r.ref_id: r.cluster_id for r in vectors.collect()}
    got = {}
    for r in index_search.scan(probed, vectors, DIMS).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.dist, r.ref_id, r.label))
    for q, v in queries:
        assert got.get(q, []) == brute([x for x in rows if cluster[x[0]] in of[q]], [(q, v)])[q]


def test_many_queries_take_bounded_memory():
    """Distances of a block of queries and references at once, whatever their number."""
    r = np.random.default_rng(1)
    n = 40_000
    queries, refs = r.integers(-100, 100, (n, DIMS)).astype(float), r.integers(-100, 100, (300, DIMS)).astype(float)
    best = exact.Best(queries, np.arange(n), 5, False)
    tracemalloc.start()
    best.meet(np.arange(n), refs, np.arange(300), np.zeros(300, dtype=np.int32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * exact.PAIRS * 8
    for i in r.integers(0, n, 50):
        d = ((refs - queries[i]) ** 2).sum(axis=1)
        assert best.ref[i].tolist() == np.lexsort((np.arange(300), d))[:5].tolist()


@pytest.mark.parametrize("parts", [1, 6])
def test_order_of_a_split_cluster(spark, parts):
    r = random.Random(3)
    rows = [(i, r.randint(0, 1) * 7, float(r.randint(0, 40))) for i in range(500)] + [(1000 + i, 3, 1.0) for i in range(9)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = index_build.cluster_order(spark.createDataFrame(rows, "ref_id long, cluster_id int, dist double")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for c in (0, 3, 7):
        mine = sorted((d, i) for i, k, d in rows if k == c)
        want += [(c, i, p // 8, p % 8) for p, (_, i) in enumerate(mine)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_recall_of_the_registered_index(spark):
    """The fast pass over the given transactions finds nine of ten of the five nearest, and its votes are right as often."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    clusters, vectors = views.tx_index(spark, sf)
    queries = catalog._requests(spark, sf)
    probed = index_search.probe(queries, clusters, views.FEATURES, views.TX_PROBES)
    near = {(r.qid, r.ref_id) for r in index_search.scan(probed, vectors, views.FEATURES).collect()}
    true = {(r.qid, r.ref_id) for r in exact.nearest(vectors, queries, views.FEATURES).collect()}
    assert len(near & true) >= 0.9 * len(true)


def test_no_machine_local_folder_on_a_cluster(spark):
    class Far:
        master = "local-cluster[2,1,1024]"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

    fake = type("F", (), {"conf": type("C", (), {"get": lambda self, k, d=None: None})(), "sparkContext": Far()})()
    with pytest.raises(ValueError, match="share"):
        shared.shared_folder(fake)


def test_queries_meet_few_references(monkeypatch):
    """Only boxes nearer than the k nearest so far are compared, and the nearest are the same."""
    r = np.random.default_rng(2)
    refs, queries = r.integers(-10000, 10000, (20_000, 3)).astype(np.int16), r.integers(-10000, 10000, (200, 3)).astype(np.int16)
    near = cells.Cells(refs[::10].astype(float), 5)
    refs = refs[np.argsort(near.of(refs), kind="stable")]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(refs))), pa.array(list(refs), pa.list_(pa.int16())), pa.array(np.zeros(len(refs), dtype=np.int32))], names=["ref_id", "v", "label"])
    query, cell = exact.asked(pa.table({"qid": np.arange(len(queries)), "qv": pa.array(list(queries), pa.list_(pa.int16()))}), 3, near)
    pairs = []
    meet = exact.Best.meet
    monkeypatch.setattr(exact.Best, "meet", lambda self, who, v, *more: (pairs.append(len(who) * len(v)), meet(self, who, v, *more)))
    seeds = next(exact._seeds(query, cell, near, iter([batch]), 5, False)).to_pandas()
    query.limit = seeds.groupby("qid")["dist"].max().to_numpy().astype(float)
    got = next(exact._best(query, iter([batch]), 5, False)).to_pandas()
    assert sum(pairs) < len(refs) * len(queries) / 5
    for i, q in enumerate(queries.astype(np.int64)):
        d = ((refs - q) ** 2).sum(axis=1)
        want = np.lexsort((np.arange(len(refs)), d))[:5]
        mine = got[got.qid == i].sort_values(["dist", "ref_id"])[:5]
        assert mine.ref_id.tolist() == want.tolist() and mine.dist.tolist() == d[want].tolist()


@pytest.mark.parametrize("probes", [1, 3])
def test_cells_change_no_answer(data, built, probes, monkeypatch):
    """With a first pass over cells, in several rounds, answers are those of one cell."""
    rows, queries, refs, qs = data
    _, clusters, vectors = built
    search = lambda **more: sorted(map(tuple, index_search.search(qs, clusters, vectors, DIMS, probes, **more).collect()))
    ways = ({"repair": False}, {}, {"low": 0, "high": 5})
    want = [search(**w) for w in ways]
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    monkeypatch.setattr(exact, "QUERY_BYTES", 1024)
    assert [search(**w) for w in ways] == want
    got = {}
    for r in exact.nearest(refs, qs, DIMS).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.dist, r.ref_id, r.label))
    assert got == brute(rows, queries)
