"""Scoring a stream of payloads: the batch operators on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.features import DIMS, with_vector
from tessera.functions.vectors import approved, fraud_score, score_body
from tessera.operators.exact import nearest, vote
from tessera.sources import http
from tessera.sources.payloads import parse
from tessera.sources.shared import Scratch

REQUEST = "conn_id long, seq long, body string"
#: STR-8: longer bodies get no response.
MOST_BODY = 8192


def score(requests: DataFrame, refs: DataFrame | Callable[[], DataFrame], decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(conn_id, seq, parse_ok, fraud_count, approved, fraud_score, response) of requests (conn_id, seq, body), a row for each row.

    What can't be parsed counts 0 and is approved (STR-9); too long a body has no row (STR-8).  `decide`
    gives (qid, fraud_count) of queries (qid, v); by default the exact neighbours among refs vote.  Requests with the same
    vector, repeated ones among them, are one query.  Refs may be given as a function, which is called only if there is a query.
    """
    scratch, spark = Scratch.of(requests.sparkSession), requests.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch.folder("requests")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    parsed = parse(requests.where(F.octet_length("body") <= MOST_BODY), "body", "conn_id", "seq")
    found = with_vector(parsed, "conn_id", "seq", "parse_ok")
    found = written(found.withColumn("v", F.when(F.col("parse_ok"), F.col("v"))))
    queries = written(found.where("parse_ok").select("v").distinct().withColumn("qid", F.monotonically_increasing_id()))
    if queries.isEmpty():  # nothing asks the references
        voted = spark.createDataFrame([], "qid long, fraud_count int")
    else:
        voted = (decide or (lambda q: vote(nearest(refs() if callable(refs) else refs, q, DIMS), q)))(queries.select("qid", "v")).select("qid", "fraud_count")
    scored = found.join(queries.join(voted, "qid").select("v", "fraud_count"), "v", "left").withColumn("fraud_count", F.coalesce("fraud_count", F.lit(0)))
    count = F.col("fraud_count")
    return scored.select("conn_id", "seq", "parse_ok", "fraud_count", approved(count).alias("approved"), fraud_score(count).alias("fraud_score"), score_body(count).alias("response"))


def serve(connections: DataFrame, raw: str, refs: DataFrame | Callable[[], DataFrame], decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(conn_id, seq, kind, response): whole responses to every whole request in the buffers of connections (conn_id and `raw`), in the
    order of `seq`; a body that is too long or can't be parsed counts 0."""
    spark = connections.sparkSession
    path = Scratch.of(spark).folder("framed")
    # buffers are dear to cut and may come in one piece: dealt to all cores, cut once
    http.frame(connections.repartition(spark.sparkContext.defaultParallelism, "conn_id"), raw, "conn_id").write.parquet(path)
    framed = spark.read.parquet(path)
    scored = score(framed.where("kind = 'score'").select("conn_id", "seq", "body"), refs, decide).select("conn_id", "seq", F.col("response").alias("json"))
    json = F.coalesce("json", score_body(F.lit(0)))
    return framed.join(scored, ["conn_id", "seq"], "left").select("conn_id", "seq", "kind", http.response(F.col("kind"), json).alias("response"))


def stream(spark: SparkSession, source: str, refs: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None, files: int = 64) -> StreamingQuery:
    """Score JSON requests that come as files in `source`; responses go to Parquet in `sink`, in a folder for each batch, so
    that a batch that is run again after a failure replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch, refs).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files).json(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
