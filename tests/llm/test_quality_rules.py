import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tessera.llm import _text as T
from tessera.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, source string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


TEXTS = [
    None, "", " \n\t ", "a", "a b c a b c", "x\nx\nx \n\n\nx", "über 東京 # * $ %&|<>", "a a a a a", "q w e r t y\nq w e r t y\n", "b c", "a b c a b c",
    "one " * 60, " ".join(f"w{i}" for i in range(70)), "\x1c \x85  z", "tail\n", " ".join(f"v{i % 900}" for i in range(60_000)),
]


@pytest.mark.parametrize("most", [1, 64, 1 << 20])
def test_measures(most):
    column = pa.array(["junk", *TEXTS], type=pa.string()).slice(1)
    got = [dict(zip(Q.MEASURES, v, strict=True)) for b in T.blocks(column, most) for v in zip(*(Q.measure(b)[m].tolist() for m in Q.MEASURES), strict=True)]
    assert got == [brute(t) for t in TEXTS]


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(70)), "too short"
    rows = [(i, good if i % 10 else bad, "a", "") for i in range(100)] + [(100 + i, bad if i % 10 else good, "b", "") for i in range(100)]
    rows += [(300, bad, "c", None), (301, good, None, None), (None, good, "a", None), (302, bad, None, None), (1, good, "a", "")]
    got = Q.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    verdict = {(r.host, r.base_failed): r.kept for r in got}
    assert verdict[("a", False)] and not verdict[("b", False)] and verdict[(None, False)]
    assert not any(r.kept for r in got if r.base_failed)
    one = next(r.rate_few_words for r in got if r.host == "c")
    assert 0.5 < one < 1  # shrunk from 1 towards the others


def test_prior():
    a, b = Q.beta_prior(2, 200, 100, 20000, 82.0)
    assert a == pytest.approx(b) and 0 < a + b < 3
    assert Q.beta_prior(0, 0, 0, 0, 0) == (0.5, 0.5)
    assert sum(Q.beta_prior(2, 200, 20, 20000, 2.0)) == pytest.approx(200)


def test_empty(spark):
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert Q.quality_rules(spark.createDataFrame([(1, None, None, None)], SCHEMA)).first().kept is False


def verdicts(rows, limits):
    """`kept` by plain counting, with the operator's own prior."""
    marked = []
    for _, text, host, _ in rows:
        m = brute(text)
        fails = {
            "few_words": m["n_words"] < limits.least_words, "repeats": 100 * m["n_repeat_words"] > limits.most_repeat_percent * m["n_words"], "symbols": 5 * m["n_symbols"] > m["n_words"],
            "repeated_lines": m["n_dup_lines"] > 4, "word_length": m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 15 * m["n_words"],
        }
        marked.append((host, fails))
    hosts = sorted({h for h, _ in marked if h is not None})
    rate = {}
    for rule in limits.rules():
        n = {h: sum(x == h for x, _ in marked) for h in hosts}
        f = {h: sum(x == h and y[rule] for x, y in marked) for h in hosts}
        a, b = Q.beta_prior(len(hosts), sum(n.values()), sum(f.values()), sum(x * x for x in n.values()), sum(f[h] ** 2 / n[h] for h in hosts))
        for h in hosts:
            rate[h, rule] = (f[h] + a) / (n[h] + a + b)
    bad = lambda h, fails: any(rate.get((h, r), 0) > limits.most_host_rate or fails[r] and rate.get((h, r), 0) > limits.known_rate for r in fails)
    return [(y["few_words"] or y["repeats"], not (y["few_words"] or y["repeats"]) and not bad(h, y)) for h, y in marked]


def fixture():
    """Host `a` is clean but for one document, most of `b` is too short, many of `c` have symbols, `d` repeats lines, and some have no host."""
    plain = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    symbols = lambda i: " ".join(f"w{i}x{j} ##" for j in range(40))
    lines = lambda i: "\n".join([f"line {i} again"] * 6 + [plain(i)])
    rows = [(i, symbols(i) if i == 7 else plain(i), "a", "") for i in range(150)]
    rows += [(200 + i, "short" if i % 4 else plain(i), "b", "") for i in range(60)] + [(300 + i, symbols(i) if i % 3 == 0 else plain(i), "c", "") for i in range(90)]
    rows += [(400 + i, lines(i) if i % 10 < 6 else plain(i), "d", "") for i in range(50)] + [(500, plain(1), None, ""), (501, symbols(1), None, ""), (502, None, None, ""), (None, symbols(2), "c", "")]
    return rows


def test_host_verdicts_decide_and_equal_sql(spark):
    rows, limits = fixture(), Q.Limits()
    got = Q.quality_rules(spark.createDataFrame(rows, SCHEMA)).select("doc_id", *Q.MEASURES, "base_failed", "kept").collect()
    by_id = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert by_id == {row[0]: v for row, v in zip(rows, verdicts(rows, limits), strict=True)}
    kept = lambda lo, hi: {by_id[i] for i in range(lo, hi)}
    assert by_id[7] == (False, True) and kept(200, 260) == {(True, False), (False, False)}  # one lone failure stays, all of b goes
    assert {by_id[300 + i] for i in range(0, 90, 3)} == {(False, False)} and by_id[301] == (False, True) and kept(400, 450) == {(False, False)} and by_id[501] == (False, True)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    key = lambda x: tuple(map(str, x))
    assert sorted(con.execute(Q.oracle()).fetchall(), key=key) == sorted(map(tuple, got), key=key)


def test_a_rate_equal_to_a_limit_stays(spark):
    limits = Q.Limits(most_host_rate=0.5, known_rate=0.5)
    good, bad = " ".join(f"w{i}" for i in range(70)), "too short"
    rows = [(i, good if i % 2 else bad, "a", "") for i in range(8)]
    got = Q.quality_rules(spark.createDataFrame(rows, SCHEMA), limits).collect()
    assert {r.rate_few_words for r in got} == {0.5} and [r.kept for r in sorted(got)] == [bool(r.doc_id % 2) for r in sorted(got)]
