import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm import mixing as M

SCHEMA = "doc_id long, text string, domain string, rate int"
WORDS = {"news": ["report", "minister", "vote"], "code": ["def", "return", "import"], "chat": ["hello", "lol", "yes"]}
SMALL = M.Settings(rows=80, bits=12, steps=80)


def corpus(n=300, seed=1):
    r = random.Random(seed)
    kinds = r.choices(list(WORDS), weights=[6, 3, 1], k=n)
    rows = [(i, " ".join(r.choices(WORDS[k] + ["the", "a"], k=r.randint(5, 80))), "c", 1) for i, k in enumerate(kinds)]
    return rows, [(i, k) for i, k in enumerate(kinds) if i % 2]


def brute(p, tokens, target, steps, most=None):
    """Every document's rate kept and moved by itself."""
    size = (p * tokens[:, None]).sum(axis=0)
    rate = np.ones(len(p))
    for _ in range(steps):
        miss = (p * (tokens * rate)[:, None]).sum(axis=0) - target
        rate = np.clip(rate - p @ (miss / size), 0, most)
    return rate


def test_rates_against_brute_force(spark):
    rows, labels = corpus()
    odd = [(900, None, "c", 1), (901, "", "c", 1), (None, "hello lol", "c", 1), (902, "vote " * 20_000, "c", 1), (902, "vote " * 20_000, "c", 1)]
    docs, table = spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame([*labels, (None, "chat"), (5, None), (1, "zzz")], "doc_id long, kind string")
    model = M.fit(docs, table, F.col("kind"), SMALL)
    assert model.domains == ("chat", "code", "news")
    weights = {"news": 0.4, "code": 0.4, "chat": 0.2}
    got = M.mix(docs, model, weights).collect()
    assert len(got) == len(rows) + len(odd)
    p, tokens, rate = np.array([[g.p_chat, g.p_code, g.p_news] for g in got]), np.array([float(g.n_tokens) for g in got]), np.array([g.rate for g in got])
    assert p.sum(axis=1) == pytest.approx(1) and sorted(g.n_tokens for g in got) == sorted(len((t or "").split()) for _, t, *_ in rows + odd)
    size = (p * tokens[:, None]).sum(axis=0)
    target = M.target_tokens(size, np.array([0.2, 0.4, 0.4]), None)
    sums = (p * (tokens * rate)[:, None]).sum(axis=0)
    assert sums == pytest.approx(target, rel=2e-3) and (rate >= 0).all()
    assert min(np.abs(brute(p, tokens, target, k) - rate).max() for k in range(41)) < 1e-9
    chosen = M.mix(docs, model, weights, total=1e6, most=3.0).collect()
    assert max(g.rate for g in chosen) <= 3.0
    truth = dict(labels)
    assert np.mean([g.domain == truth[g.doc_id] for g in got if g.doc_id in truth]) > 0.95


def test_least_squares_where_targets_cannot_be_met():
    r = np.random.default_rng(3)
    p, tokens = r.dirichlet([1, 1, 1], 200), r.integers(1, 50, 200).astype(float)
    size = (p * tokens[:, None]).sum(axis=0)
    target = size * [1.0, 0.0, 0.0]

    rate = np.ones(len(p))
    costs = []

    def sums(steps):  # called after each step
        rate[:] = np.maximum(rate - p @ np.array(steps[-1]), 0)
        now = (p * (tokens * rate)[:, None]).sum(axis=0)
        costs.append((((now - target) ** 2) / size).sum())
        return now

    steps, now = M.projected_gradient(sums, size, target, 50_000, 1e-7)
    assert np.all(np.diff(costs) <= 1e-9) and costs[39] < 0.2 * costs[0]  # never overshoots, and is near after the usual rounds
    pull = p @ ((now - target) / size)
    assert np.abs(pull[rate > 0]).max() < 0.02 and pull[rate == 0].min() > -0.02  # no rate can move to lower the misses


def test_targets():
    assert M.target_tokens(np.array([100.0, 50.0, 0.0]), np.array([0.5, 0.5, 1.0]), None) == pytest.approx([50, 50, 0])
    assert M.target_tokens(np.array([100.0, 50.0]), np.array([3.0, 1.0]), 400) == pytest.approx([300, 100])
    assert M.target_tokens(np.array([100.0, 50.0]), np.array([0.0, 0.0]), None).sum() == 0


def test_drawn(spark):
    rows, labels = corpus()
    docs, table = spark.createDataFrame([*rows, (None, "hello", "c", 1)], SCHEMA), spark.createDataFrame(labels, "doc_id long, kind string")
    model = M.fit(docs, table, "kind", SMALL)
    weights = {"news": 0.5, "code": 0.5}
    kept = M.drawn(docs, model, weights, total=20_000)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    rate = {x.doc_id: x.rate for x in M.mix(docs, model, weights, total=20_000).collect()}
    assert ids.count(None) == 1 and max(rate.values()) > 1
    assert all(int(rate[d]) <= ids.count(d) <= int(rate[d]) + 1 for d in rate if d is not None)
    odd = docs.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("__gone"), F.lit(3).alias("a.b"))
    assert M.drawn(odd, model, weights).columns == odd.columns


@pytest.mark.parametrize("way", [{"most": 1.0, "whole": "news"}, {"total": 60_000}])
def test_realised_shares(spark, way):
    """Tokens of the rows drawn, by the posteriors, stand to each other as the weights."""
    r = random.Random(8)
    kinds = r.choices(list(WORDS), weights=[6, 3, 2], k=1500)
    rows = [(i, " ".join(r.choices(WORDS[k] + r.choices(sum(WORDS.values(), []), k=2), k=r.randint(5, 60))), "c", 1) for i, k in enumerate(kinds)]
    docs, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "doc_id long, kind string")
    model = M.fit(docs, table, "kind", M.Settings(rows=300, bits=12, steps=80))
    weights = {"news": 0.7, "code": 0.2, "chat": 0.1}
    found = {x.doc_id: x for x in M.mix(docs, model, weights, **way).collect()}
    share = lambda ids: np.array([sum(found[d].n_tokens * found[d][f"p_{k}"] * (k != "news" or found[d].domain == "news" or "whole" not in way) for d in ids) for k in weights])
    if "whole" in way:  # kept documents count as what they likeliest are
        found = {d: x if x.domain != "news" else Row(**(x.asDict() | {f"p_{k}": float(k == "news") for k in weights})) for d, x in found.items()}
    expected = np.array([sum(x.rate * x.n_tokens * x[f"p_{k}"] * (k != "news" or x.domain == "news" or "whole" not in way) for x in found.values()) for k in weights])
    assert expected / expected.sum() == pytest.approx(list(weights.values()), abs=2e-3)
    ids = [x.doc_id for x in M.drawn(docs, model, weights, **way).collect()]
    assert share(ids) / share(ids).sum() == pytest.approx(list(weights.values()), abs=0.02)
    if "whole" in way:
        assert len(ids) == len(set(ids)) and all(x.rate == 1 for x in found.values() if x.domain == "news") and {d for d, x in found.items() if x.domain == "news"} <= set(ids)
    else:
        assert share(ids).sum() == pytest.approx(60_000, rel=0.05) and len(ids) > len(set(ids))


@pytest.mark.parametrize("labels", [[], [(1, "x")], [(1, "x"), (2, "y")]])
def test_few_rows(spark, labels):
    docs, table = spark.createDataFrame([(1, "a b", "c", 1), (2, None, "c", 1)], SCHEMA), spark.createDataFrame(labels, "doc_id long, kind string")
    got = M.mix(docs, M.fit(docs, table, "kind", SMALL), {"x": 1.0}).collect()
    assert len(got) == 2 and all(g.rate >= 0 for g in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix(empty, M.fit(empty, table, "kind", SMALL), {"x": 1.0}).count() == 0


def test_posteriors_do_not_depend_on_blocks():
    r = np.random.default_rng(4)
    model = M.Model(("a", "b"), r.standard_normal((1 << 12, 2)), np.zeros(2), SMALL)
    texts = pa.array(["one two two", None, "", "three " * 500, "one"])
    whole = [M.document_posteriors(model, b)[0] for b in T.blocks(texts)]
    parts = [M.document_posteriors(model, b)[0] for b in T.blocks(texts, 4)]
    assert np.concatenate(whole) == pytest.approx(np.concatenate(parts))


def test_targets_with_a_whole_domain():
    for size in ([900.0, 60.0, 40.0], [989.0, 10.0, 1.0], [990.0, 10.0, 0.0], [1000.0, 0.0, 0.0], [750.0, 130.0, 120.0]):
        size = np.array(size)
        got = M.target_tokens(size, np.array([0.86, 0.08, 0.06]), None, 0)
        assert got == pytest.approx(np.minimum(size, size[0] / 0.86 * np.array([0.86, 0.08, 0.06])))
        assert got[0] == size[0]


@pytest.mark.parametrize("toxic", [1, 0])
def test_a_scarce_domain_thins_no_other(spark, tmp_path, toxic):
    import corpus_pipeline as P

    r = random.Random(6)
    words = {"clean": [f"c{i}" for i in range(80)], "low": [f"l{i}" for i in range(80)], "toxic": [f"t{i}" for i in range(80)]}
    of = ["toxic"] * (4 * toxic) + ["low"] * 80 + ["clean"] * (320 - 4 * toxic)  # 1 % or 0 % toxic, 20 % low
    rows = [(i, " ".join(r.choices(words[k], k=60)), "c", 1) for i, k in enumerate(of)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, int(k != "low"), int(k == "toxic")) for i, k in enumerate(of)] + [(1000, 1, 1)]  # one whose text is gone
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id for x in P.mixed(spark, docs, str(tmp_path)).collect()}
    left = {k: sum(of[i] == k for i in kept) for k in words}
    assert left["clean"] == of.count("clean") and left["toxic"] == of.count("toxic") and 0 < left["low"] < 60, left


@pytest.mark.parametrize("sharp", [2.5, 1.5, 1.0])
def test_soft_domains_meet_their_targets(spark, monkeypatch, sharp):
    r = np.random.default_rng(1)
    logits = r.normal(size=(2000, 3)) * 0.7
    logits[np.arange(2000), r.choice(3, 2000, p=[0.75, 0.13, 0.12])] += sharp
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    marked = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(r.integers(20, 900, 2000), p, strict=True))], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    monkeypatch.setattr(M, "posteriors", lambda *_: marked)
    model = M.Model(("clean", "low", "toxic"), np.zeros((1, 3)), np.zeros(3), M.Settings())
    got = M.mix(marked, model, {"clean": 0.9, "low": 0.06, "toxic": 0.04}).collect()
    share = np.array([[g.p_clean, g.p_low, g.p_toxic] for g in got]) * np.array([[g.n_tokens] for g in got])
    target = M.target_tokens(share.sum(axis=0), np.array([0.9, 0.06, 0.04]), None)
    assert (share * np.array([[g.rate] for g in got])).sum(axis=0) == pytest.approx(target, rel=1e-3) and min(g.rate for g in got) >= 0


def test_nearest_step_where_targets_cannot_be_met():
    r = np.random.default_rng(3)
    p, tokens = r.dirichlet([1, 1, 1], 200), r.integers(1, 50, 200).astype(float)
    size = (p * tokens[:, None]).sum(axis=0)
    target = size * [1.0, 0.0, 0.0]

    def moments(step):
        rate = np.maximum(1 - p @ np.array(step), 0)
        return (tokens * rate * rate).sum() / 2, (p * (tokens * rate)[:, None]).sum(axis=0), (p * (tokens * (rate > 0))[:, None]).T @ p

    step, now, settled = M.nearest_step(moments, size, target, np.zeros(3), 1e-4)
    rate, pull = np.maximum(1 - p @ np.array(step), 0), p @ ((now - target) / size)
    assert settled and np.abs(pull[rate > 0]).max() < 0.01 and pull[rate == 0].min() > -0.01  # no rate can move to lower the misses
