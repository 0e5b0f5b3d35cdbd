"""From raw documents to packed training sequences, in five stages of the llm operators.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, near_copies, packing, queries, suffixes
from tessera.llm._tables import Tables

#: Least probability of a document's language.
LEAST_LANGUAGE = 0.5
#: Shingles of five words, 4 of 5 of all of them shared, make a near copy.
NEAR_WORDS, NEAR_LEAST = 5, (4, 5)
#: The domain whose documents all stay; the others are thinned to op7's shares of tokens beside it.
WHOLE = "clean"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with none likely enough, go."""
    return langid.accepted(docs, langid.fit(docs), LEAST_LANGUAGE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: what SimHash, or bands where its bits
    don't reach, brings together is compared as whole sets."""
    return near_copies.first_of_each(docs, NEAR_WORDS, NEAR_LEAST)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them."""
    return suffixes.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains over their share of tokens are thinned out; labels tell what domains look like."""
    model = mixing.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(queries.DOMAIN))
    return mixing.drawn(docs, model, queries.TARGETS, most=1.0, whole=WHOLE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of at most 1024 tokens."""
    return packing.pack(docs, queries.tokenizer_path(), limit=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", suffix_dedup), ("mixing", mixed), ("best_fit_packing", packed),
]

#: Trained models and tokenisers have no SQL; tests hold run() against the stages' own brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
