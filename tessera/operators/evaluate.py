"""Evaluation of decisions against expected ones, and tuning of repair thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.exact import K
from tessera.operators.index_search import OFF


def replay(voted: DataFrame, cases: DataFrame) -> DataFrame:
    """EVL-1: cases (qid, expected_approved, expected_count) with their decision; what couldn't be parsed counts 0 and is approved."""
    joined = cases.join(voted.select("qid", "fraud_count", "worst"), "qid", "left")
    return joined.withColumn("parsed", F.col("fraud_count").isNotNull()).withColumn("fraud_count", F.coalesce("fraud_count", F.lit(0))).withColumn("approved", F.col("fraud_count") <= 2)


def histogram(replayed: DataFrame, k: int = K) -> DataFrame:
    """EVL-2: (fraud_count, n) for every count from 0 to k."""
    every = replayed.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("fraud_count"))
    n = replayed.groupBy("fraud_count").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "fraud_count", "left").select("fraud_count", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def report(replayed: DataFrame) -> DataFrame:
    """EVL-3 .. EVL-6: one row of counters, the weighted error, and whether all decisions are right."""
    wrong = F.col("approved") != F.col("expected_approved")
    counted = replayed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("parsed")).alias("parse_errors"), F.count_if(F.col("fraud_count") == F.col("expected_count")).alias("exact_match"),
        F.count_if(~wrong).alias("approve_match"), F.count_if(wrong & ~F.col("approved")).alias("false_positives"), F.count_if(wrong & F.col("approved")).alias("false_negatives"),
    )
    return counted.withColumn("weighted_error", F.col("false_positives") + 3 * F.col("false_negatives")).withColumn("passed", (F.col("false_positives") == 0) & (F.col("false_negatives") == 0))


def tune(replayed: DataFrame, k: int = K) -> DataFrame:
    """EVL-7, EVL-8: (fraud_count, total, wrong, threshold) for every count: the smallest worst distance of a wrong decision
    among unanimous counts, else off; what couldn't be parsed, or has no worst distance, says nothing of distances."""
    spark: SparkSession = replayed.sparkSession
    sure = replayed.where(F.col("parsed") & F.col("fraud_count").isin(0, k))
    wrong = F.col("approved") != F.col("expected_approved")
    found = sure.groupBy("fraud_count").agg(F.count(F.lit(1)).alias("total"), F.count_if(wrong).alias("wrong"), F.min(F.when(wrong, F.col("worst"))).alias("least"))
    every = spark.range(k + 1).select(F.col("id").cast("int").alias("fraud_count")).join(found, "fraud_count", "left")
    zero, off = F.lit(0).cast("long"), F.lit(OFF).cast("long")
    return every.select("fraud_count", F.coalesce("total", zero).alias("total"), F.coalesce("wrong", zero).alias("wrong"), F.least(F.coalesce("least", off), off).alias("threshold"))
