import random

import pytest

import corpus_pipeline as P
from tessera.llm import langid, mixing, queries
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_packing import brute_best_fit, expected_ids
from tests.llm.test_suffixes import brute_cut

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(11)
    syllables = {"xx": ["th", "er", "ing", "and", "ou"], "yy": ["sch", "ü", "ung", "ei", "ß"]}
    word = lambda k: "".join(r.choices(syllables[k], k=r.randint(1, 3)))
    passage = [word("xx") for _ in range(70)]
    rows, labels = [], []
    for i in range(220):
        k = r.choice(["xx", "yy"])
        words = [word(k) for _ in range(r.randint(60, 300))]
        kind = r.random()
        if kind < 0.15:
            words = [w + "***" for w in words]
        if 0.15 <= kind < 0.25:
            words[3:3] = passage
        rows.append((i, " ".join(words), k, "s", len(" ".join(words))))
        labels.append((i, int(kind >= 0.15), 0))
    rows += [(300 + i, rows[i][1], rows[i][2], "s", rows[i][4]) for i in range(20)]
    rows += [(400, None, "xx", "s", None), (401, "", None, None, 0), (402, "12 34", "yy", "s", 5), (None, "and thing", "xx", "s", 9)]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, assertions = docs.columns, 0
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        got = stage(spark, docs, sf)
        got.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert after.columns == columns
            texts = {r.doc_id: r.text for r in after.collect()}
        if name == "language_id":
            model = langid.fit(docs)
            want = {p.doc_id for p in langid.predict(docs, model).collect() if p.lang_pred != "und" and p.score >= P.LEAST_LANGUAGE}
            assert set(texts) == want and not {400, 401, 402} & want
        if name == "simhash_near_dedup":
            parts = brute_kept([(d, t) for d, t in before if d is not None])
            assert set(texts) - {None} == parts and (None in texts) == (None in dict(before)) and not any(d and d >= 300 for d in texts)
        if name == "suffix_array_dedup":
            want = dict(brute_cut([(d, t) for d, t in before], 50)) | ({None: dict(before)[None]} if None in dict(before) else {})
            assert texts == want and texts != dict(before)
        if name == "mixing":
            model = mixing.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), queries.F.expr(queries.DOMAIN))
            found = {r.doc_id: r for r in mixing.mix(docs, model, queries.TARGETS, most=1.0, whole="clean").collect()}
            rates = {d: r.rate for d, r in found.items()}
            assert max(rates.values()) <= 1 and {d for d, rate in rates.items() if rate == 1} <= set(texts) < set(dict(before)) and not any(rates[d] == 0 for d in texts if d is not None)
            assert {d for d, r in found.items() if r.domain == "clean"} <= set(texts)
        if name == "best_fit_packing":
            of = expected_ids()
            sizes = [len(of(t or "")) + 1 for _, t in before]
            sizes = [x for n in sizes for x in ([1024] * (n // 1024) + [n % 1024] * (n % 1024 > 0))]
            assert sorted(r.length for r in after.collect()) == sorted(sizes)
            assert after.select("sequence_id").distinct().count() == len(brute_best_fit(sizes, 1024))
        docs = after
        assertions += 1
    assert assertions == 5
    key = lambda x: tuple(map(str, x))
    assert sorted(P.run(spark, sf).drop("sequence_id", "offset").collect(), key=key) == sorted(docs.drop("sequence_id", "offset").collect(), key=key)


def test_empty(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
