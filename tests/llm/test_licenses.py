import random
import re
import time

import pytest

from tessera.llm import licenses as L

SCHEMA = "doc_id long, text string, n_words string, words int"


def brute(text):
    """Detections as (first, last, priority, rule) of every rule, and those that stay, over all pairs."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = " " + "  ".join(words) + " "
    found = []
    for i, r in enumerate(L.RULES):
        if r.keyword in words and (not r.licensed or "license" in words or "licence" in words):
            for m in re.finditer(r.regex, line):
                first = line[: m.start()].count(" ") // 2
                found.append((first, first + m.group().count(" ") // 2, r.priority, i))
    inside = lambda x, y: x != y and y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:2] != x[:2] or y[2:] < x[2:])
    return words, found, [x for x in found if not any(inside(x, y) for y in found)]


def expected(doc, text):
    words, found, stay = brute(text)
    base = [x for x in found if L.RULES[x[3]].base]
    label = lambda xs: ",".join(sorted({L.RULES[x[3]].label for x in xs}))
    starts = [x[0] for x in base]
    return (doc, len(words), len(base), min(starts, default=None), max(starts, default=None), label(base), label(base + stay), max((L._WEIGHTS[x[2]] for x in stay), default=0.0), sorted(stay))


def test_against_brute_force(spark):
    r = random.Random(1)
    vocabulary = ["licensed", "under", "the", "apache", "license", "version", "2", "0", "gnu", "general", "public", "CC", "BY", "nc", "4", "mit", "bsd", "all", "rights", "reserved", "spdx", "identifier", "lesser", "Mozilla", "domain", "copyright", "2020", "x"]
    phrases = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0", "CC BY-SA 4.0", "GNU Lesser General Public License v2.1", "https://creativecommons.org/licenses/by-nc/3.0/", "Creative Commons Attribution Non-Commercial 4.0 International", "all rights reserved", "cc by cc by"]
    texts = [" ".join(r.choices(vocabulary, k=r.choice([2, 8, 40, 200]))) for _ in range(120)]
    texts += [r.choice([", ", "\n", " é "]).join(r.choices([*phrases, *vocabulary], k=20)) for _ in range(60)]
    texts += ["", None, "...", "\x00\n", "ÀLL rights reserved", "ALL-RIGHTS\tRESERVED", "all rights reservedé", "cc by " * 2000, "x " * 20000]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "mit license", "c", 1), (1, "cc by", "c", 1), (1, "cc by", "c", 1)]
    got = L.scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    have = [(*g[:-1], sorted((x["first"], -x["minus_last"], x["priority"], x["rule"]) for x in g.detections)) for g in got]
    key = lambda x: tuple(map(str, x))
    assert sorted(have, key=key) == sorted((expected(d, t) for d, t, *_ in rows), key=key)


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"), ("Released under the MIT License.", "mit"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("All rights reserved.", "reserved"), ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"), ("an open question about the general public", ""), ("Some rights reserved", "reserved"),
])
def test_examples(spark, text, labels):
    assert L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_rules():
    assert len(L.RULES) > 600 and len(set(L.SIGNATURES)) > 190
    for r in L.RULES:
        assert r.keyword in re.sub(r"[^a-z0-9 ]", " ", r.pattern).split()
        assert not re.search(r.regex, "  ")


def test_empty_and_native(spark, capsys):
    df = L.scan(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    df.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_time_grows_with_the_text(spark):
    """Many detections in one text: 48,000 of base phrases and as many words around."""
    took = []
    for n in (6000, 48_000):
        df = spark.createDataFrame([(1, "cc by " * n + "all rights reserved " * n)], "doc_id long, text string")
        began = time.perf_counter()
        row = L.scan(df).first()
        took.append(time.perf_counter() - began)
        assert row.n_base == 2 * n and row.first_word == 0 and row.last_word == 5 * n - 3
    assert took[1] < 8 * 3 * took[0] and took[1] < 60
