"""Registered queries of the scoring engine and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.features import DIMS as FEATURES
from tessera.functions.features import features, mcc_risk, with_vector
from tessera.functions.vectors import fraud_score, quantize, score_body, squared_l2
from tessera.operators import evaluate, exact, index_build, index_search
from tessera.plans import views as V
from tessera.sources import http, payloads
from tessera.sources.shared import Scratch
from tessera.streaming import scorer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_D = [f"d{i}" for i in range(FEATURES)]


def _ints(df: DataFrame) -> DataFrame:
    return df.select(*V.KEYS, *[F.col(d).cast("int").alias(d) for d in _D])


# SC-7, VEC


@query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, {V._q('embedding[i]')} AS value FROM embeddings, range(1, 65) AS t(i)")
def quantize_embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return e.select("vec_id", "dim", quantize(F.col("x")).cast("int").alias("value"))


@query(f"WITH {V.SQL_REFS} SELECT a.qid, b.ref_id, {V.sql_l2('a.v', 'b.v')} AS dist FROM qs AS a, refs AS b WHERE a.qid % 50 = 0")
def l2_distance_pairs(spark, sf_dir):
    q = V.query_set(spark, sf_dir).where("qid % 50 = 0").withColumnRenamed("v", "qv")
    rounds = exact.in_rounds(q, V.DIMS, "pairs", lambda part, _: V.refs(spark, sf_dir).crossJoin(F.broadcast(part)).select("qid", "ref_id", squared_l2("qv", "v", V.DIMS).alias("dist")))
    return rounds


# SRC-3, FEAT, SC-1..10


@query(f"WITH {V.SQL_FEATURES} SELECT * FROM feat")
def feature_vector(spark, sf_dir):
    return _ints(features(V.tx(spark, sf_dir), *V.KEYS))


@query(f"WITH {V.SQL_FEATURES} SELECT {', '.join(V.KEYS)}, CAST(i AS INTEGER) AS dim, ([{', '.join(_D)}])[i + 1] AS value FROM feat, range(0, 14) AS t(i)")
def feature_long(spark, sf_dir):
    return with_vector(V.tx(spark, sf_dir), *V.KEYS).select(*V.KEYS, F.posexplode(F.transform("v", lambda x: x.cast("int"))).alias("dim", "value"))


@query(f"WITH {V.SQL_FEATURES} SELECT *, true AS parse_ok FROM feat")
def payload_parse(spark, sf_dir):
    parsed = payloads.parse(payloads.to_payload(V.tx(spark, sf_dir), *V.KEYS), "body", *V.KEYS)
    return features(parsed, *V.KEYS, "parse_ok").select(*V.KEYS, "parse_ok", *[F.col(d).cast("int").alias(d) for d in _D])


@query(f"WITH {V.SQL_TX} SELECT mcc, CAST({V._RISK} AS FLOAT) AS risk, count(*) AS n FROM tx GROUP BY ALL")
def mcc_risk_agg(spark, sf_dir):
    return V.tx(spark, sf_dir).groupBy("mcc").agg(F.count(F.lit(1)).alias("n")).select("mcc", mcc_risk(F.col("mcc")).alias("risk"), "n")


@query(f"WITH {V.SQL_TX} SELECT {', '.join(V.KEYS)}, merchant_id FROM tx WHERE list_contains(known_merchants, merchant_id)")
def known_merchant_semi(spark, sf_dir):
    return V.tx(spark, sf_dir).where(F.array_contains("known_merchants", F.col("merchant_id"))).select(*V.KEYS, "merchant_id")


# KNN-1, 4, 6; SNK-2; SC-11, 12


@query(f"WITH {V.SQL_TOP} SELECT qid, CAST(rank AS INTEGER) AS rank, ref_id, dist, label FROM top")
def knn_exact_top5(spark, sf_dir):
    return exact.nearest(V.refs(spark, sf_dir), V.query_set(spark, sf_dir), V.DIMS, skip_self=True)


@query(f"WITH {V.SQL_TOP} SELECT qid, CAST(rank AS INTEGER) AS rank, ref_id, dist, label FROM top")
def knn_exact_columns(spark, sf_dir):
    return exact.nearest(V.refs(spark, sf_dir), V.query_set(spark, sf_dir), V.DIMS, skip_self=True, way="columns")


@query(f"WITH {V.SQL_TOP}, {V.SQL_VOTE} SELECT * FROM vote")
def knn_vote(spark, sf_dir):
    return exact.vote(knn_exact_top5(spark, sf_dir), V.query_set(spark, sf_dir))


@query(f"WITH {V.SQL_TOP}, {V.SQL_VOTE} SELECT qid, fraud_count, fraud_count <= 2 AS approved, CAST(fraud_count / 5.0 AS DECIMAL(3, 2)) AS fraud_score, format('{{{{\"approved\": {{}}, \"fraud_score\": {{:.2f}}}}}}', fraud_count <= 2, fraud_count / 5.0) AS response FROM vote")
def score_response(spark, sf_dir):
    c = F.col("fraud_count")
    return knn_vote(spark, sf_dir).select("qid", "fraud_count", (c <= 2).alias("approved"), fraud_score(c).alias("fraud_score"), score_body(c).alias("response"))


# IVF-1 .. 13


@query(f"WITH {V.SQL_REFS} SELECT ref_id, label FROM refs ORDER BY md5(ref_id || '-{index_build.SEED}'), ref_id LIMIT {index_build.SAMPLE}")
def sample_refs(spark, sf_dir):
    return index_build.sample(V.refs(spark, sf_dir)).select("ref_id", "label")


@query(f"WITH {V.SQL_TRAIN} SELECT cluster_id, CAST(i - 1 AS INTEGER) AS dim, centroid[i] AS value FROM cent{V.ROUNDS}, range(1, {V.DIMS + 1}) AS t(i)")
def train_centroids(spark, sf_dir):
    return V.centroids(spark, sf_dir).select("cluster_id", F.posexplode("centroid").alias("dim", "x")).select("cluster_id", "dim", F.col("x").cast("int").alias("value"))


@query()
def train_seeded(spark, sf_dir):
    return index_build.rounded(index_build.train(V.refs(spark, sf_dir), V.DIMS, clusters=V.CLUSTERS, rounds=20))


@query()
def kmeans_ml(spark, sf_dir):
    return index_build.rounded(index_build.train_ml(V.refs(spark, sf_dir), clusters=V.CLUSTERS, rounds=20))


@query(f"WITH {V.SQL_INDEX} SELECT ref_id, cluster_id, dist FROM asg")
def assign_clusters(spark, sf_dir):
    return V.index(spark, sf_dir)[1].select("ref_id", "cluster_id", F.col("dist").cast("long").alias("dist"))


@query(f"WITH {V.SQL_INDEX} SELECT * FROM cnts")
def cluster_counts(spark, sf_dir):
    return V.index(spark, sf_dir)[0].select("cluster_id", "cnt")


@query(f"WITH {V.SQL_INDEX} SELECT cluster_id, cnt, CAST(coalesce(sum((cnt + 7) // 8) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_start FROM cnts")
def block_offsets(spark, sf_dir):
    return V.index(spark, sf_dir)[0].select("cluster_id", "cnt", "block_start")


@query(f"WITH {V.SQL_INDEX} SELECT cluster_id, CAST(i - 1 AS INTEGER) AS dim, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM long")
def cluster_bbox(spark, sf_dir):
    clusters = V.index(spark, sf_dir)[0]
    return clusters.select("cluster_id", F.posexplode(F.arrays_zip("bbox_min", "bbox_max")).alias("dim", "b")).select("cluster_id", "dim", F.col("b.bbox_min").cast("int").alias("lo"), F.col("b.bbox_max").cast("int").alias("hi"))


@query(f"WITH {V.SQL_INDEX}, o AS (SELECT cluster_id, ref_id, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, ref_id) - 1 AS p FROM asg) SELECT cluster_id, ref_id, CAST(p // 8 AS INTEGER) AS block, CAST(p % 8 AS INTEGER) AS lane FROM o")
def cluster_order(spark, sf_dir):
    return index_build.cluster_order(V.index(spark, sf_dir)[1])


@query(f"WITH {V.SQL_TRAIN} SELECT cluster_id, CAST(i - 1 AS INTEGER) AS dim, centroid[i] AS value FROM cent1, range(1, {V.DIMS + 1}) AS t(i)")
def lloyd_step(spark, sf_dir):
    moved = index_build.rounded(index_build.lloyd_step(V.refs(spark, sf_dir), V.first_centroids(spark, sf_dir), V.DIMS))
    return moved.select("cluster_id", F.posexplode("centroid").alias("dim", "x")).select("cluster_id", "dim", F.col("x").cast("int").alias("value"))


@query(f"WITH {V.sql_tx(False)} SELECT cluster_id, cnt, CAST((SELECT count(*) FROM asg) AS BIGINT) AS n FROM cnts")
def index_round_trip(spark, sf_dir):
    clusters, vectors = V.tx_index(spark, sf_dir)
    n = vectors.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cnt"))
    every = clusters.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))
    return every.withColumn("n", F.lit(clusters.agg(F.sum("cnt")).first()[0]))


# KNN-2, 3, 5, 7, 8, 9; VEC-3


def _requests(spark, sf_dir):
    """(qid, v) of the requests that can be parsed, from their bodies, which are read several times."""
    requests = V.tx_requests(spark, sf_dir).select(F.col("seq").alias("qid"), "body")
    path = Scratch.of(spark).folder("asked")
    with_vector(payloads.parse(requests, "body", "qid").where("parse_ok"), "qid").write.parquet(path)
    return spark.read.parquet(path)


def _search(spark, sf_dir, queries=None, probes=V.TX_PROBES, **more):
    """Of requests in the written index over all transactions."""
    clusters, vectors = V.tx_index(spark, sf_dir)
    return index_search.search(queries if queries is not None else _requests(spark, sf_dir), clusters, vectors, FEATURES, probes, **more)


@query(f"WITH {V.SQL_INDEX} SELECT qid, cluster_id, d FROM probes")
def probe_select(spark, sf_dir):
    return index_search.probe(V.query_set(spark, sf_dir), V.centroids(spark, sf_dir), V.DIMS, V.PROBES).select("qid", "cluster_id", "d")


@query(f"WITH {V.SQL_INDEX} SELECT * FROM bound")
def bbox_lower_bound(spark, sf_dir):
    return index_search.bounds(V.query_set(spark, sf_dir), V.index(spark, sf_dir)[0], V.DIMS).select("qid", "cluster_id", "bound")


@query(f"WITH {V.sql_tx(False)} SELECT * FROM fvote")
def ivf_fast_pass(spark, sf_dir):
    return _search(spark, sf_dir, repair=False)


@query(f"WITH {V.SQL_INDEX}, {V.sql_repair(1, 4, dims=V.DIMS, skip_self=True)} SELECT * FROM cand")
def repair_candidates(spark, sf_dir):
    clusters, vectors = V.index(spark, sf_dir)
    queries = V.query_set(spark, sf_dir)
    probed = index_search.probe(queries, clusters, V.DIMS, V.PROBES)
    need = index_search.needs_repair(exact.vote(index_search.scan(probed, vectors, V.DIMS, skip_self=True), queries))
    return index_search.repair_candidates(queries, need, probed, clusters, V.DIMS).select("qid", "cluster_id", "bound")


@query(f"WITH {V.sql_tx(False)}, {V.sql_repair(1, 4)} SELECT * FROM vote")
def ivf_default(spark, sf_dir):
    return _search(spark, sf_dir)


@query(f"WITH {V.SQL_INDEX}, {V.sql_repair(1, 4, dims=V.DIMS, skip_self=True)} SELECT * FROM vote")
def ivf_repaired(spark, sf_dir):
    """Of embeddings, with so few probes of so many dimensions that repair has much to do."""
    clusters, vectors = V.index(spark, sf_dir)
    return index_search.search(V.query_set(spark, sf_dir), clusters, vectors, V.DIMS, V.PROBES, skip_self=True)


#: KNN-10: thresholds as they are given from outside: all unanimous answers whose fifth neighbour isn't near are looked at again.
THRESHOLDS = "100000,4294967295,4294967295,4294967295,4294967295,1000"


@query(f"WITH {V.sql_tx(False, 1)}, {V.sql_repair(1, 4, tuple(map(int, THRESHOLDS.split(','))))} SELECT * FROM vote")
def ivf_thresholds(spark, sf_dir):
    return _search(spark, sf_dir, probes=1, thresholds=index_search.thresholds_from(THRESHOLDS))


@query(f"WITH {V.SQL_TX_EXACT} SELECT * FROM vote")
def ivf_exact(spark, sf_dir):
    return _search(spark, sf_dir, low=0, high=5)


@query(f"WITH {V.SQL_TX_EXACT} SELECT * FROM vote")
def knn_exact_features(spark, sf_dir):
    queries = _requests(spark, sf_dir)
    return exact.vote(exact.nearest(V.tx_index(spark, sf_dir)[1], queries, FEATURES), queries)


# EVL-1 .. 8


def _replayed(spark, sf_dir, repair):
    """Bodies through the features and the search; some can't be parsed."""
    cases = V.cases(spark, sf_dir)
    queries = with_vector(payloads.parse(cases, "body", "qid").where("parse_ok"), "qid")
    return evaluate.replay(_search(spark, sf_dir, queries, repair=repair), cases.drop("body"))


_SQL_REPAIRED = f"WITH {V.sql_tx(True)}, {V.sql_repair(1, 4)}, {V.sql_replayed('vote')}"


@query(
    f"{_SQL_REPAIRED} SELECT count(*) AS total, count(*) FILTER (NOT parsed) AS parse_errors, count(*) FILTER (fraud_count = expected_count) AS exact_match, count(*) FILTER (approved = expected_approved) AS approve_match, "
    "count(*) FILTER (NOT approved AND expected_approved) AS false_positives, count(*) FILTER (approved AND NOT expected_approved) AS false_negatives, "
    "count(*) FILTER (NOT approved AND expected_approved) + 3 * count(*) FILTER (approved AND NOT expected_approved) AS weighted_error, count(*) FILTER (approved <> expected_approved) = 0 AS passed FROM rep"
)
def confusion_report(spark, sf_dir):
    return evaluate.report(_replayed(spark, sf_dir, True))


@query(f"{_SQL_REPAIRED} SELECT CAST(i AS INTEGER) AS fraud_count, count(qid) AS n FROM range(0, 6) AS t(i) LEFT JOIN rep ON fraud_count = i GROUP BY i")
def score_histogram(spark, sf_dir):
    return evaluate.histogram(_replayed(spark, sf_dir, True))


@query(
    f"WITH {V.sql_tx(True)}, {V.sql_replayed('fvote')} SELECT CAST(i AS INTEGER) AS fraud_count, count(qid) AS total, count(qid) FILTER (approved <> expected_approved) AS wrong, "
    "least(coalesce(min(worst) FILTER (approved <> expected_approved), 4294967295), 4294967295) AS threshold FROM range(0, 6) AS t(i) LEFT JOIN rep ON parsed AND fraud_count = i AND i IN (0, 5) GROUP BY i"
)
def tune_thresholds(spark, sf_dir):
    return evaluate.tune(_replayed(spark, sf_dir, False))


# SRC-1, 2, 4, 7; SC-16, 17; SNK-3; STR-7, 8, 10


def _objects(spark, sf_dir, vector, fraud):
    """Labelled vectors of all embeddings as JSON texts; some are short."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    short = F.when(F.col("vec_id") % 7 == 0, 9).otherwise(F.size("embedding"))
    values = F.transform(F.slice("embedding", F.lit(1), short), lambda x: F.round(x.cast("double"), 3))
    return e.select(F.to_json(F.struct(values.alias(vector), fraud)).alias("text"))


_SQL_ROWS = "SELECT CAST(round(CAST(greatest(-10000.0, least(10000.0, round(CAST(embedding[1] AS DOUBLE), 3) * 10000)) AS DOUBLE)) AS INTEGER) AS first, CAST(round(CAST(greatest(-10000.0, least(10000.0, round(CAST(embedding[14] AS DOUBLE), 3) * 10000)) AS DOUBLE)) AS INTEGER) AS last, CAST({} AS INTEGER) AS label, count(*) AS n FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY ALL"


def _ends(rows):
    return rows.groupBy(F.get("v", F.lit(0)).cast("int").alias("first"), F.get("v", F.lit(13)).cast("int").alias("last"), F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(_SQL_ROWS.format("label < 5"))
def reference_rows(spark, sf_dir):
    texts = _objects(spark, sf_dir, "vector", F.when(F.col("label") < 5, "fraud").otherwise("legit").alias("label"))
    rows = texts.select(F.from_json("text", payloads.REFERENCES).alias("j")).select("j.*")
    return _ends(payloads.labelled(rows))


@query(_SQL_ROWS.format("label < 5 OR vec_id % 3 = 0"))
def reference_objects(spark, sf_dir):
    note = F.when(F.col("label") < 5, F.lit("a fraud")).when(F.col("vec_id") % 3 == 0, F.lit("not_fraudulent")).otherwise(F.lit("fine"))
    return _ends(payloads.labelled_objects(_objects(spark, sf_dir, "any name", note.alias("note")), "text"))


_PART_1, _PART_2, _PART_3, _END = V.raw_parts("strlen")
_SQL_FRAMES = (
    f"b AS (SELECT c_custkey AS conn_id, c_custkey % 4 AS kind_of_end, {V.BODY_1} AS body_1, {V.BODY_2} AS body_2, strlen({_PART_1}) AS n_1, strlen({_PART_2}) AS n_2, strlen({_PART_3}) AS n_3, strlen({V._PUT}) AS n_put, strlen({_END}) AS n_end FROM customer), "
    "f AS (SELECT conn_id, 0 AS seq, 'score' AS kind, body_1 AS body, n_1 AS consumed FROM b UNION ALL SELECT conn_id, 1, 'ready', NULL, n_2 FROM b UNION ALL SELECT conn_id, 2, 'score', body_2, n_3 FROM b UNION ALL SELECT conn_id, 3, 'bad', NULL, n_put FROM b WHERE kind_of_end = 2)"
)


@query(f"WITH {_SQL_FRAMES} SELECT conn_id, CAST(seq AS INTEGER) AS seq, kind, body, CAST(consumed AS INTEGER) AS consumed FROM f")
def http_frame(spark, sf_dir):
    return http.frame(V.connections(spark, sf_dir), "raw", "conn_id")


@query(f"WITH {_SQL_FRAMES} SELECT conn_id, CAST(n_1 + n_2 + n_3 + CASE WHEN kind_of_end = 2 THEN n_put ELSE 0 END AS INTEGER) AS consumed, CAST(n_end - CASE WHEN kind_of_end = 2 THEN n_put ELSE 0 END AS INTEGER) AS left, kind_of_end = 2 AS closed FROM b")
def http_remainder(spark, sf_dir):
    return http.remainder(V.connections(spark, sf_dir), "raw", "conn_id").select("conn_id", "consumed", "left", "closed")


@query(f"WITH {_SQL_FRAMES} SELECT conn_id, strlen(body_1) AS n FROM b")
def content_length(spark, sf_dir):
    return V.connections(spark, sf_dir).select("conn_id", http.content_length(F.col("raw")).alias("n"))


_OK, _LINES = "HTTP/1.1 200 OK", "chr(13) || chr(10)"
_SQL_OK = f"'HTTP/1.1 200 OK' || {_LINES} || 'Content-Length: 2' || {_LINES} || 'Connection: keep-alive' || {_LINES} || {_LINES} || 'OK'"
_SQL_400 = f"'HTTP/1.1 400 Bad Request' || {_LINES} || 'Content-Length: 0' || {_LINES} || 'Connection: close' || {_LINES} || {_LINES}"
_SQL_JSON = f"'HTTP/1.1 200 OK' || {_LINES} || 'Content-Type: application/json' || {_LINES} || 'Connection: keep-alive' || {_LINES} || 'Content-Length: ' || strlen({{0}}) || {_LINES} || {_LINES} || {{0}}"
_SQL_BODY = "format('{{\"approved\": {}, \"fraud_score\": {:.2f}}}', fraud_count <= 2, fraud_count / 5.0)"


@query(f"WITH {_SQL_FRAMES} SELECT conn_id, CAST(seq AS INTEGER) AS seq, kind, CASE kind WHEN 'ready' THEN {_SQL_OK} WHEN 'bad' THEN {_SQL_400} ELSE {_SQL_JSON.format(_SQL_BODY.replace('fraud_count', '0'))} END AS response FROM f".replace("format('{\"", "format('{{\""))
def http_serve(spark, sf_dir):
    """No body here is a payload: all scores fail open."""
    return scorer.serve(V.connections(spark, sf_dir), "raw", lambda: V.tx_index(spark, sf_dir)[1])


# STR-2, 5, 7, 8, 9


_SQL_SCORES = (
    f"WITH {V.SQL_TX_EXACT} SELECT l_orderkey AS conn_id, qid AS seq, true AS parse_ok, fraud_count, fraud_count <= 2 AS approved, CAST(fraud_count / 5.0 AS DECIMAL(3, 2)) AS fraud_score, {_SQL_BODY} AS response "
    f"FROM vote JOIN (SELECT l_orderkey, {V.TX_ID} AS qid FROM feat) USING (qid)"
)


@query(_SQL_SCORES)
def batch_score(spark, sf_dir):
    return scorer.score(V.tx_requests(spark, sf_dir), V.tx_index(spark, sf_dir)[1])


def _streamed(spark, sf_dir, again):
    path = Scratch.of(spark).folder("stream")
    V.tx_requests(spark, sf_dir).repartition(3).write.json(f"{path}/in")
    if again:  # as a client that tries anew sends them
        V.tx_requests(spark, sf_dir).where("seq % 3 = 0").coalesce(1).write.mode("append").json(f"{path}/in")
    running = scorer.stream(spark, f"{path}/in", V.tx_index(spark, sf_dir)[1], f"{path}/out", f"{path}/state", files=2)
    running.awaitTermination()
    if running.exception():
        raise running.exception()
    return spark.read.parquet(f"{path}/out").drop("batch")


@query(_SQL_SCORES)
def stream_score(spark, sf_dir):
    return _streamed(spark, sf_dir, False)


@query(f"{_SQL_SCORES}, (SELECT unnest([1, 2]) AS time) WHERE time = 1 OR qid % 3 = 0")
def stream_repeated(spark, sf_dir):
    return _streamed(spark, sf_dir, True)
