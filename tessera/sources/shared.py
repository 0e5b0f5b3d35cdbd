"""The folder that the driver and all executors share, and what stands there for a while."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs in this process, as in tests, a new local one."""
    folder = spark.conf.get(_OWN, None) or spark.sparkContext.getConf().get(_OWN)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {_OWN} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Folders of one session in the shared folder, removed when the process ends."""

    _known: dict[str, Scratch] = {}

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self.kept: dict[tuple, str] = {}
        atexit.register(self.clear)

    @classmethod
    def of(cls, spark: SparkSession) -> Scratch:
        key = spark.sparkContext.applicationId
        if key not in cls._known:
            cls._known[key] = cls(spark)
        return cls._known[key]

    def folder(self, name: str) -> str:
        self.paths.append(new_folder(self.spark, name))
        return self.paths[-1]

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is None:
                return
            jvm = self.spark.sparkContext._jvm
            for path in self.paths:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session or its gateway has ended before
            return
