"""Transactions as JSON payloads, labelled reference vectors and test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.features import DIMS, from_units, to_time, units
from tessera.functions.vectors import quantize_array

_N = "DECIMAL(28,18)"
PAYLOAD = (
    f"id STRING, transaction STRUCT<amount: {_N}, installments: {_N}, requested_at: STRING>, customer STRUCT<avg_amount: {_N}, tx_count_24h: {_N}, known_merchants: ARRAY<STRING>>, "
    f"merchant STRUCT<id: STRING, mcc: STRING, avg_amount: {_N}>, terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: {_N}>, last_transaction STRUCT<timestamp: STRING, km_from_current: {_N}>"
)
REFERENCES = "vector ARRAY<DOUBLE>, label STRING"
CASES = f"entries ARRAY<STRUCT<request: STRUCT<{PAYLOAD.replace('id STRING', 'id: STRING', 1).replace('transaction STRUCT', 'transaction: STRUCT', 1).replace('customer STRUCT', 'customer: STRUCT').replace('merchant STRUCT', 'merchant: STRUCT').replace('terminal STRUCT', 'terminal: STRUCT').replace('last_transaction STRUCT', 'last_transaction: STRUCT')}>, expected_approved: BOOLEAN, expected_fraud_score: DOUBLE>>"


#: Numbers of a transaction and where a payload has them.
_NUMBERS = {
    "amount": "transaction.amount", "installments": "transaction.installments", "avg_amount": "customer.avg_amount", "tx_count_24h": "customer.tx_count_24h", "merchant_avg": "merchant.avg_amount",
    "km_from_home": "terminal.km_from_home", "last_km": "last_transaction.km_from_current",
}


def parse(payloads: DataFrame, body: str, *keys: str) -> DataFrame:
    """SRC-3: keys, parse_ok and the transaction's columns of JSON payloads; numbers by SC-3.  A payload without a readable
    request time or merchant id is not ok; what else is missing is 0, false or null."""
    j = lambda path: F.col(f"j.{path}")
    others = [
        to_time(j("transaction.requested_at")).alias("requested_at"), to_time(j("last_transaction.timestamp")).alias("last_at"), j("customer.known_merchants").alias("known_merchants"), j("merchant.id").alias("merchant_id"),
        j("merchant.mcc").alias("mcc"), j("terminal.is_online").alias("is_online"), j("terminal.card_present").alias("card_present"),
    ]
    parsed = payloads.select(*keys, F.from_json(body, PAYLOAD).alias("j"))
    # decimals become whole numbers once, and are taken apart as such
    flat = parsed.select(*keys, *[units(j(path)).alias(name) for name, path in _NUMBERS.items()], *others)
    whole = flat.withColumns({name: from_units(F.col(name)) for name in _NUMBERS})
    return whole.withColumn("parse_ok", F.col("requested_at").isNotNull() & F.col("merchant_id").isNotNull())


def to_payload(tx: DataFrame, *keys: str) -> DataFrame:
    """Keys and `body`: transactions as JSON, an explicit null where there is no last one."""
    money = lambda c: F.col(c).cast("decimal(12,2)")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    last = F.when(F.col("last_at").isNotNull(), F.struct(stamp("last_at").alias("timestamp"), money("last_km").alias("km_from_current")))
    body = F.struct(
        F.struct(money("amount").alias("amount"), money("installments").alias("installments"), stamp("requested_at").alias("requested_at")).alias("transaction"),
        F.struct(money("avg_amount").alias("avg_amount"), money("tx_count_24h").alias("tx_count_24h"), F.col("known_merchants")).alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), F.col("mcc"), money("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", money("km_from_home").alias("km_from_home")).alias("terminal"), last.alias("last_transaction"),
    )
    return tx.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def labelled(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """SRC-2: (v, label) of rows with `vector` and `label`: short vectors go, long ones are cut, label 1 is fraud."""
    whole = rows.where(F.size("vector") >= dims)
    return whole.select(quantize_array(F.transform(F.slice("vector", 1, dims), lambda x: F.coalesce(x, F.lit(0.0)))).alias("v"), F.coalesce(F.col("label") == "fraud", F.lit(False)).cast("tinyint").alias("label"))


def labelled_objects(texts: DataFrame, text: str, dims: int = DIMS) -> DataFrame:
    """SRC-2 as it reads any names: (v, label) of JSON objects as text, in which the first list is the vector (what is no number in it is 0),
    and the label is 1 where `fraud` stands anywhere."""
    inside = F.regexp_extract(text, r"\[([^\]]*)", 1)
    numbers = F.transform(F.split(inside, ","), lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0)))
    rows = texts.select(F.when(F.trim(inside) != "", numbers).otherwise(F.array().cast("array<double>")).alias("vector"), F.contains(F.col(text), F.lit("fraud")).alias("fraud"))
    return rows.where(F.size("vector") >= dims).select(quantize_array(F.slice("vector", 1, dims)).alias("v"), F.coalesce("fraud", F.lit(False)).cast("tinyint").alias("label"))


def read_references(spark: SparkSession, path: str, dims: int = DIMS, partitions: int | None = None) -> DataFrame:
    """SRC-1: a JSON array of labelled vectors, gzipped or not.  One such file can't be split, so rows are
    dealt out anew; JSON lines (one object a line) are split by Spark and read the same way."""
    rows = labelled(spark.read.schema(REFERENCES).json(path, multiLine=True), dims)
    return rows.repartition(partitions) if partitions else rows


def cases(rows: DataFrame) -> DataFrame:
    """SRC-4: (case_id, body, expected_approved, expected_count) of rows with `entries`."""
    one = rows.select(F.posexplode("entries").alias("case_id", "e"))
    return one.select("case_id", F.to_json("e.request").alias("body"), F.coalesce("e.expected_approved", F.lit(True)).alias("expected_approved"), F.round(F.coalesce("e.expected_fraud_score", F.lit(0.0)) * 5).cast("int").alias("expected_count"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return cases(spark.read.schema(CASES).json(path, multiLine=True))
