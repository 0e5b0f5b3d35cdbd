"""Tables in the folder that the driver and all executors share.

A written table cuts lineage: an executor that is lost later costs its own tasks only, and
what is read back is the same however often it is read.
"""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import new_folder


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop(spark, path)
    except Exception:  # noqa: BLE001  the session or its gateway has ended before
        return


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of `docs`, all columns, whose key isn't among those of the one column of `gone`; the rows are one struct
    meanwhile, so their columns may have any names."""
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(gone.toDF("key"), "key", "left_anti").select("row.*")


class Tables:
    """Names written tables of one operator run; `drop` removes those no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, new_folder(spark, name)
        self.count = 0
        atexit.register(_at_exit, spark, self.top)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.top}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def written(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        drop(self.spark, path)
