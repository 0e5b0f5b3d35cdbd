import json
import math
import random
import re
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import features as X
from tessera.functions import vectors as V
from tessera.sources import http, payloads



def payload(seed):
    """An invented transaction, as a dictionary."""
    r = random.Random(seed)
    stamp = lambda: f"20{r.randint(20, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}Z"
    shops = [f"shop-{r.randint(1, 9)}" for _ in range(r.randint(0, 4))]
    money = lambda: round(r.choice([r.uniform(0, 50), r.uniform(0, 20_000)]), r.randint(0, 6))
    last = None if r.random() < 0.3 else {"timestamp": stamp(), "km_from_current": money() / 10}
    return {
        "id": f"é{seed}", "transaction": {"amount": money(), "installments": r.randint(1, 24), "requested_at": stamp()}, "customer": {"avg_amount": r.choice([0, money()]), "tx_count_24h": r.randint(0, 30), "known_merchants": shops},
        "merchant": {"id": f"shop-{r.randint(1, 9)}", "mcc": r.choice([*X.MCC_RISK, "0742"]), "avg_amount": money()}, "terminal": {"is_online": r.random() < 0.5, "card_present": r.random() < 0.5, "km_from_home": money() / 10}, "last_transaction": last,
    }


def expected(p):
    """Its features, one operation in single precision after the other."""
    f = np.float32

    def number(x):
        whole, _, part = f"{Decimal(repr(x)):f}".partition(".")
        part = part[:8].rstrip("0")
        return f(int(whole)) + (f(int(part)) / f(10 ** len(part)) if part else f(0))

    clamp = lambda x: max(f(0), min(f(1), x))
    per = lambda x, most: f(x) * f(1 / most)
    at = datetime.strptime(p["transaction"]["requested_at"], "%Y-%m-%dT%H:%M:%SZ")
    average, last = number(p["customer"]["avg_amount"]), p["last_transaction"]
    average = average if average > 0 else f(1)
    minutes = km = f(-1)
    if last:
        seconds = int((at - datetime.strptime(last["timestamp"], "%Y-%m-%dT%H:%M:%SZ")).total_seconds())
        minutes, km = clamp(per(f(seconds) / f(60), 1440)), clamp(per(number(last["km_from_current"]), 1000))
    amount = number(p["transaction"]["amount"])
    values = [
        clamp(per(amount, 10000)), clamp(per(number(p["transaction"]["installments"]), 12)), clamp(per(amount / average, 10)), per(at.hour, 23), per(at.weekday(), 6), minutes, km, clamp(per(number(p["terminal"]["km_from_home"]), 1000)),
        clamp(per(number(p["customer"]["tx_count_24h"]), 20)), f(p["terminal"]["is_online"]), f(p["terminal"]["card_present"]), f(p["merchant"]["id"] not in p["customer"]["known_merchants"]), f(X.MCC_RISK.get(p["merchant"]["mcc"], 0.5)), clamp(per(number(p["merchant"]["avg_amount"]), 10000)),
    ]
    scaled = [max(-10000.0, min(10000.0, float(v) * 10000)) for v in values]
    return [int(math.copysign(math.floor(abs(x) + 0.5), x)) for x in scaled]


PAYLOADS = [payload(i) for i in range(200)]
P1, P2 = json.dumps(PAYLOADS[0]), json.dumps(PAYLOADS[1], ensure_ascii=False)
D1, D2 = expected(PAYLOADS[0]), expected(PAYLOADS[1])


def test_payloads_in_single_precision(spark):
    df = spark.createDataFrame([(i, json.dumps(p, ensure_ascii=i % 2 == 0)) for i, p in enumerate(PAYLOADS)], "id int, body string")
    got = X.with_vector(payloads.parse(df, "body", "id"), "id").orderBy("id").collect()
    assert [r.v for r in got] == [expected(p) for p in PAYLOADS]
    assert len({tuple(r.v) for r in got}) > 190 and any(r.v[5] == -10000 for r in got) and any(r.v[5] > 0 for r in got)


@pytest.mark.parametrize("change", ["{bad", "", "null", "[]", '{"transaction":{}}'])
def test_unreadable_payloads(spark, change):
    got = payloads.parse(spark.createDataFrame([(1, change), (2, None)], "id int, body string"), "body", "id").collect()
    assert [r.parse_ok for r in got] == [False, False]


def test_missing_and_odd_values(spark):
    a, b, c = json.loads(P1), json.loads(P1), json.loads(P1)
    b["transaction"]["requested_at"] = c["transaction"]["requested_at"] = "2027-07-09T16:31:06Z"
    del a["terminal"], a["customer"]["known_merchants"], a["merchant"]["mcc"]
    b["transaction"]["amount"], b["customer"]["avg_amount"], b["transaction"]["requested_at"] = -5, -883.18, "2027-07-09T16:31:06-03:00"
    c["transaction"]["requested_at"] = "2027-07-09"
    df = spark.createDataFrame(list(enumerate(map(json.dumps, (a, b, c)))), "id int, body string")
    parsed = payloads.parse(df, "body", "id")
    assert [r.parse_ok for r in parsed.orderBy("id").collect()] == [True, True, False]
    v = [r.v for r in X.with_vector(parsed.where("parse_ok"), "id").orderBy("id").collect()]
    assert v[0][9:13] == [0, 0, 10000, 5000] and v[0][7] == 0
    assert v[1][0] == 0 and v[1][2] == 0 and v[1][3] == 6957


def test_quantize(spark):
    cases = [(0.5, 5000), (-0.1, -1000), (1.5, 10000), (-1.0, -10000), (0.0, 0), (1.0, 10000), (0.00005, 1), (-0.00005, -1), (float("nan"), 0), (float("inf"), 10000)]
    got = spark.createDataFrame(cases, "x double, want int").select(V.quantize(F.col("x")).alias("q"), "want").collect()
    assert all(r.q == r.want for r in got)


def test_decimals_in_single_precision(spark):
    r = random.Random(1)
    texts = [f"{r.randrange(10**r.randint(1, 6))}.{r.randrange(1, 10**8):08d}".rstrip("0") for _ in range(2000)] + ["0", "7", "0.0001", "-3.5"]

    def want(t):
        if t.startswith("-"):
            return np.float32(0)
        whole, _, part = t.partition(".")
        return np.float32(np.float32(int(whole)) + (np.float32(int(part)) / np.float32(10 ** len(part)) if part else np.float32(0)))

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.from_decimal(F.col("t").cast("decimal(38,18)")).alias("x")).orderBy("i").collect()
    assert [np.float32(g.x) for g in got] == [want(t) for t in texts]


def test_scores(spark):
    got = spark.range(9).select("id", V.score_body(F.col("id")).alias("b"), V.fraud_score(F.col("id")).alias("s"), V.approved(F.col("id")).alias("a")).collect()
    for g in got:
        n = min(g.id, 5)
        assert (g.a, str(g.s), g.b) == (n < 3, f"{n / 5:.2f}", f'{{"approved": {"true" if n < 3 else "false"}, "fraud_score": {n / 5:.2f}}}')


def test_bound_is_under_distance(spark):
    r = random.Random(2)
    box = lambda: sorted([r.randint(-9, 9), r.randint(-9, 9)])
    rows = []
    for i in range(100):
        sides = [box() for _ in range(3)]
        rows.append((i, [r.randint(-9, 9) for _ in range(3)], [a for a, _ in sides], [b for _, b in sides], [r.randint(a, b) for a, b in sides]))
    got = spark.createDataFrame(rows, "i int, v array<smallint>, lo array<smallint>, hi array<smallint>, x array<smallint>").select("i", V.box_bound("v", "lo", "hi", 3).alias("b"), V.squared_l2("v", "x", 3).alias("d"), V.squared_l2("v", "v", 3).alias("z")).collect()
    assert all(0 <= g.b <= g.d and g.z == 0 for g in got)
    for g, (_, v, lo, hi, x) in zip(sorted(got), rows, strict=True):
        assert g.d == sum((a - b) ** 2 for a, b in zip(v, x)) and g.b == sum(max(0, a - p, p - b) ** 2 for p, a, b in zip(v, lo, hi))


def test_references(spark, tmp_path):
    path = tmp_path / "refs.json"
    path.write_text(json.dumps([{"vector": [0.5] * 14, "label": "legit"}, {"vector": [-1.0] * 15, "label": "fraud"}, {"vector": [0.5] * 3, "label": "fraud"}, {"vector": [None] + [0.1] * 13}]))
    got = payloads.read_references(spark, str(path), partitions=2).collect()
    assert sorted((r.v[0], len(r.v), r.label) for r in got) == [(-10000, 14, 1), (0, 14, 0), (5000, 14, 0)]


def test_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"entries": [{"request": json.loads(P1), "expected_approved": False, "expected_fraud_score": 0.6}, {"request": json.loads(P2)}]}))
    rows = payloads.read_cases(spark, str(path))
    assert [(r.expected_approved, r.expected_count) for r in rows.orderBy("case_id").collect()] == [(False, 3), (True, 0)]
    assert [r.v for r in X.with_vector(payloads.parse(rows, "body", "case_id"), "case_id").orderBy("case_id").collect()] == [D1, D2]


def test_objects_of_any_names(spark):
    texts = ['{"x":[' + ",".join(["0.25"] * 14) + '],"note":"no fraud here"}', '{"a":"b","v":[' + ",".join(["1", "x", "-2"] * 5) + "]}", '{"v":[1,2],"k":"fraud"}', '{"v":[]}', "{}", None]
    got = payloads.labelled_objects(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert sorted((list(r.v), r.label) for r in got) == sorted([([2500] * 14, 1), ([10000, 0, -10000] * 4 + [10000, 0], 0)])


def brute_frames(raw):
    """Requests of a buffer byte by byte: frames, bytes consumed, closed."""
    out, at, closed = [], 0, False
    while not closed:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            break
        head, stop = raw[at : end + 4], end + 4
        if head.startswith(b"POST"):
            n = re.search(rb"(?i)content-length: *([0-9]*)", head)
            stop += int(n.group(1) or 0) if n else 0
            if stop > len(raw):
                break
        kind = "score" if head.startswith(b"POST") else "ready" if head.startswith(b"GET") else "bad"
        out.append((len(out), kind, raw[end + 4 : stop].decode(errors="replace") if kind == "score" else None, stop - at))
        at, closed = stop, kind == "bad"
    return out, at, closed or len(raw) - at >= http.BUFFER


def test_frames_against_brute_force(spark):
    r = random.Random(4)
    bodies = ["", "{}", '{"name":"Čapek 東京"}', "a\r\n\r\nGET / b", "🙂" * 30]

    def request():
        body = r.choice(bodies)
        name = r.choice(["Content-Length:", "content-length: ", "CONTENT-LENGTH:    "])
        return r.choice([f"POST /score HTTP/1.1\r\nA: b\r\n{name}{len(body.encode())}\r\n\r\n{body}", "GET /x HTTP/1.1\r\n\r\n", "POST / HTTP/1.1\r\n\r\n"] + ["DELETE / HTTP/1.1\r\n\r\n"] * (r.random() < 0.2))

    raws = []
    for _ in range(150):
        raw = "".join(request() for _ in range(r.randint(0, 6))).encode()
        raws.append(raw[: r.randint(0, len(raw))] if r.random() < 0.4 else raw)
    raws += [b"", b"x" * 9000, b"POST / HTTP/1.1\r\nContent-Length: 99999999999\r\n\r\n", b"POST / HTTP/1.1\r\nContent-Length: 9000\r\n\r\n" + b"y" * 9000]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw binary")
    got, left = {}, {x.id: x for x in http.remainder(df, "raw", "id").collect()}
    for x in http.frame(df, "raw", "id").collect():
        got.setdefault(x.id, []).append((x.seq, x.kind, x.body, x.consumed))
    for i, raw in enumerate(raws):
        frames, at, closed = brute_frames(raw)
        assert sorted(got.get(i, [])) == frames, raw
        assert (left[i].consumed, left[i].left, left[i].closed) == (at, len(raw) - at, closed) and (closed or bytes(left[i].rest) == raw[at:])
    assert http.frame(spark.createDataFrame([(1, None)], "id int, raw string"), "raw", "id").count() == 0


def test_responses(spark):
    got = [x.r for x in spark.createDataFrame([("score", '{"é":1}'), ("ready", None), ("bad", None)], "k string, b string").select(http.response(F.col("k"), F.col("b")).alias("r")).collect()]
    for text in got:
        head, _, body = text.partition("\r\n\r\n")
        assert f"Content-Length: {len(body.encode())}" in head
    assert got[0].startswith("HTTP/1.1 200 OK\r\n") and got[0].endswith('{"é":1}') and got[1].endswith("OK") and got[2].startswith("HTTP/1.1 400") and "close" in got[2]


def test_features_of_all_rows_are_cheap_and_the_same(spark):
    """By blocks and by expressions, nulls and odd numbers included; neither rounds by way of decimal texts."""
    times = "CASE WHEN id % 5 = 0 THEN NULL ELSE timestamp_seconds(id * 7919) END"
    odd = lambda i: f"CASE id % 11 WHEN {i} THEN NULL WHEN {i + 1} THEN double('NaN') WHEN {i + 2} THEN double('-Infinity') WHEN {i + 3} THEN double('Infinity') WHEN {i + 4} THEN -0.25 ELSE id * 1.7 END"
    tx = spark.range(400).selectExpr(
        "id", f"{odd(0)} AS amount", "CASE WHEN id % 4 = 0 THEN NULL ELSE int(id % 15) END AS installments", f"{times} AS requested_at", f"{odd(3)} AS avg_amount", f"{odd(5)} AS tx_count_24h",
        "CASE WHEN id % 6 > 0 THEN array('a', 'b') END AS known_merchants", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'x' END AS merchant_id", "CASE WHEN id % 2 = 0 THEN '7995' END AS mcc", f"{odd(6)} AS merchant_avg",
        "CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_online", "CASE id % 7 WHEN 0 THEN true WHEN 1 THEN false END AS card_present", f"{odd(2)} AS km_from_home",
        "CASE WHEN id % 3 > 0 THEN timestamp_seconds(id * 7000) END AS last_at", f"{odd(1)} AS last_km",
    )
    wanted, got = tx.select("id", F.array(*X.feature_columns(tx)).alias("v")), X.with_vector(tx, "id")
    assert wanted.orderBy("id").collect() == got.orderBy("id").collect()
    halves = [k / 20000 for k in range(-20001, 20002, 7)] + [None, float("nan"), 0.49999999999999994 / 10000]
    rows = spark.createDataFrame([(x,) for x in halves], "x double")
    plain = F.round(F.greatest(F.lit(-1e4), F.least(F.lit(1e4), F.nanvl("x", F.lit(0.0)) * 1e4))).cast("smallint")
    assert all(r.a == r.b for r in rows.select(plain.alias("a"), V.quantize(F.col("x")).alias("b")).collect())
    assert " round(" not in rows.select(V.quantize(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
