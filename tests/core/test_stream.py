import json

from tests.core.test_functions import D1, D2, P1, P2

from tessera.streaming import scorer


def test_stream_equals_batch(spark, tmp_path):
    refs = spark.createDataFrame([(i, D1 if i < 4 else D2, int(i < 4)) for i in range(12)], "ref_id long, v array<smallint>, label int")
    rows = [(1, 1, P1), (1, 2, P2), (2, 1, "{bad"), (2, 2, "x" * 9000), (3, 1, json.dumps({"transaction": {}}))]
    for i, row in enumerate(rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(dict(zip(("conn_id", "seq", "body"), row, strict=True))))
    query = scorer.stream(spark, str(tmp_path / "in"), refs, str(tmp_path / "out"), str(tmp_path / "state"), files=2)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").orderBy("conn_id", "seq").collect()
    batch = scorer.score(spark.createDataFrame(rows, scorer.REQUEST), refs).orderBy("conn_id", "seq").collect()
    assert got == batch
    assert [(r.conn_id, r.seq, r.parse_ok, r.fraud_count, r.approved) for r in got] == [(1, 1, True, 4, False), (1, 2, True, 0, True), (2, 1, False, 0, True), (3, 1, False, 0, True)]


def test_repeated_requests_keep_their_number(spark):
    refs = spark.createDataFrame([(i, D1 if i < 4 else D2, int(i < 4)) for i in range(12)], "ref_id long, v array<smallint>, label int")
    rows = [(1, 1, P1), (1, 1, P1), (1, 2, P2), (1, 1, "{bad"), (None, None, P1)]
    got = scorer.score(spark.createDataFrame(rows, scorer.REQUEST), refs).collect()
    assert sorted((str(r.conn_id), str(r.seq), r.parse_ok, r.fraud_count) for r in got) == [("1", "1", False, 0), ("1", "1", True, 4), ("1", "1", True, 4), ("1", "2", True, 0), ("None", "None", True, 4)]


def test_serve_answers_every_request_in_order(spark):
    refs = spark.createDataFrame([(i, D1 if i < 4 else D2, int(i < 4)) for i in range(12)], "ref_id long, v array<smallint>, label int")
    post = lambda b: f"POST / HTTP/1.1\r\nContent-Length: {len(b.encode())}\r\n\r\n{b}"
    raw = post(P2) + "GET / HTTP/1.1\r\n\r\n" + post(P1) + post("é") + post("x" * 8000)[:500]
    got = scorer.serve(spark.createDataFrame([(7, raw), (8, "PUT / HTTP/1.1\r\n\r\n" + post(P1)), (9, "")], "conn_id long, raw string"), "raw", refs).orderBy("conn_id", "seq").collect()
    assert [(r.conn_id, r.seq, r.kind) for r in got] == [(7, 0, "score"), (7, 1, "ready"), (7, 2, "score"), (7, 3, "score"), (8, 0, "bad")]
    assert got[0].response == got[3].response and got[0].response.endswith('{"approved": true, "fraud_score": 0.00}') and got[2].response.endswith('{"approved": false, "fraud_score": 0.80}') and got[4].response.startswith("HTTP/1.1 400")


def test_references_are_not_made_without_a_query(spark):
    def refs():
        raise AssertionError("nothing asks")

    got = scorer.score(spark.createDataFrame([(1, 1, "{bad"), (1, 2, "")], scorer.REQUEST), refs).collect()
    assert sorted((r.seq, r.parse_ok, r.fraud_count, r.approved) for r in got) == [(1, False, 0, True), (2, False, 0, True)]
