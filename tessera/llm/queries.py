"""The registered queries of this subpackage: thin glue over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, licenses, media, mixing, packing, quality_model, quality_rules, simhash, suffixes, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), words=3, distance=3)


def op2_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).drop("detections")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    """The byte-level BPE file that contracts name, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path(), limit=1024, end_id=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_documents(spark, sf_dir))
    return found.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


#: A document's domain from its labels, and the shares of tokens to aim at.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'clean' END"
TARGETS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = mixing.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(DOMAIN))
    return mixing.mix(docs, model, TARGETS)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_model.predict(docs, quality_model.fit(docs))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store_text(_documents(spark, sf_dir)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_simhash": op1_simhash, "op2_suffix_arrays": op2_suffix_arrays, "op3_license_scan": op3_license_scan, "op4_language_id": op4_language_id, "op5_best_fit_packing": op5_best_fit_packing, "op6_quality_rules": op6_quality_rules, "op7_mixing": op7_mixing, "op8_quality_classifier": op8_quality_classifier, "op9_media": op9_media, "op10_toxicity": op10_toxicity}

ORACLES: dict[str, str] = {"op3_license_scan": licenses.oracle(), "op6_quality_rules": quality_rules.oracle()}
