"""The index as Parquet tables: `index_meta`, `centroids` and `vectors` by cluster.

Vectors are dealt by cluster and cell and sorted so inside (near ones stand together), so a cluster's rows stand
together and a scan of few clusters skips the other row groups by their statistics.  Few clusters may be
folders of their own as well (`partition=True`); thousands would make too many small files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessera.operators.cells import Cells, blocks, cells_of, drawn, flat

VERSION = 1
#: Rows of a part of the vectors, and rows that a task deals at once.
PART_ROWS, DEALT_ROWS = 250_000, 500_000
OPENED = "ref_id long, v array<smallint>, label int, cluster_id int"
_BLOCKS = "part int, ref_id binary, v binary, label binary, cluster_id binary, cell binary"


@dataclass
class Layout:
    """Where vectors go: to parts by ranges of cluster, cell and a hash of the id, so a hot cluster or cell is split."""

    cells: Cells
    bounds: np.ndarray

    @classmethod
    def of(cls, n: int, rows: pa.Table, dims: int, partitions: int) -> Layout:
        """For n vectors, of which rows (ref_id, v, cluster_id) are a sample."""
        found = cls(cells_of(n, rows, dims), np.zeros(0, dtype=np.int64))
        if rows.num_rows:
            code = np.sort(found.codes(flat(rows.column("v").combine_chunks()), *(rows.column(c).to_numpy() for c in ("ref_id", "cluster_id")))[1])
            found.bounds = code[np.arange(1, partitions) * len(code) // partitions]
        return found

    def codes(self, v: np.ndarray, ids: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.cells.of(v)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        return cell, (cluster.astype(np.int64) << 32) + (cell.astype(np.int64) << 16) + mixed.astype(np.int64)

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part that some rows go to: a shuffle of a few blocks costs far less than one of rows."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= DEALT_ROWS:
                yield from self._blocks(pa.Table.from_batches(held).combine_chunks())
                held = []
        if held:
            yield from self._blocks(pa.Table.from_batches(held).combine_chunks())

    def _blocks(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        if any(rows.column(c).null_count for c in rows.column_names):
            raise ValueError("nulls among vectors, ids, labels or clusters")
        v, (ids, label, cluster) = flat(rows.column("v").combine_chunks()), (rows.column(c).to_numpy() for c in ("ref_id", "label", "cluster_id"))
        cell, code = self.codes(v, ids, cluster)
        part = np.searchsorted(self.bounds, code, "right").astype(np.int32)
        order = np.argsort(part.astype(np.int16) if len(self.bounds) < 1 << 15 else part, kind="stable")
        kinds, first = np.unique(part[order], return_index=True)
        ends = np.append(first, len(order))
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *(blocks(x[order], ends) for x in (ids, v, label, cluster, cell))], names=["part", "ref_id", "v", "label", "cluster_id", "cell"])


def _laid(kinds: dict[str, np.dtype], dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A part's blocks as rows again, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
        for batch in batches:
            for c in kinds:
                held[c] += [np.frombuffer(x.as_buffer(), dtype=kinds[c]) for x in batch.column(c)]
        if not held["cell"]:
            return
        ids, v, label, cluster, cell = (np.concatenate(held.pop(c)) for c in ("ref_id", "v", "label", "cluster_id", "cell"))
        v, order = v.reshape(-1, dims), np.lexsort((ids, cell, cluster))
        for lo in range(0, len(order), 1 << 15):
            own = order[lo : lo + (1 << 15)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * dims), pa.array(v[own].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), lists, pa.array(label[own]), pa.array(cluster[own])], names=["ref_id", "v", "label", "cluster_id"])

    return run


def write_index(path: str, clusters: DataFrame | Callable[[DataFrame], DataFrame], assigned: DataFrame, dims: int, partition: bool = False, partitions: int | None = None, sample: tuple[int, pa.Table] | None = None, opened: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> None:
    """SNK-1.  clusters as index_build.cluster_table() makes them, or a function that makes them of the written vectors; assigned with ref_id, v,
    label, cluster_id.  `sample` has the number of vectors and some of them (ref_id, v, cluster_id); with it and a function, assigned is run once.
    With `opened` and a sample, assigned is whatever that makes such rows of in a task, with ids of 64 bits, labels of 32 and coordinates of 16."""
    spark = assigned.sparkSession
    if sample is None:
        n, rows = drawn(assigned)
        mine = spark.createDataFrame(rows.select(["ref_id"])).distinct()
        sample = n, assigned.join(F.broadcast(mine), "ref_id", "left_semi").select("ref_id", "v", "cluster_id").toArrow()
    n, rows = sample
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS)
    layout = Layout.of(n, rows.combine_chunks(), dims, partitions)
    mine = assigned if opened else assigned.select("ref_id", "v", "label", "cluster_id")
    types = {f.name: f.dataType for f in (StructType.fromDDL(OPENED) if opened else mine.schema).fields}
    kinds = {c: np.dtype(to_arrow_type(types[c].elementType if c == "v" else types[c]).to_pandas_dtype()) for c in types} | {"cell": np.dtype(np.int32)}
    schema = ", ".join(f"{c} {types[c].simpleString()}" for c in types)
    deal = (lambda batches: layout.deal(b.select(list(types)) for b in opened(batches))) if opened else layout.deal
    dealt = mine.mapInArrow(deal, _BLOCKS).repartitionById(partitions, F.col("part")).mapInArrow(_laid(kinds, dims), schema)
    writer = dealt.write.mode("overwrite")
    (writer.partitionBy("cluster_id") if partition else writer).parquet(f"{path}/vectors")
    (clusters(spark.read.parquet(f"{path}/vectors")) if callable(clusters) else clusters).write.mode("overwrite").parquet(f"{path}/centroids")
    written = spark.read.parquet(f"{path}/centroids").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"), F.count(F.lit(1)).cast("int").alias("k"))
    written.select(F.lit(VERSION).alias("version"), "n", "k", F.lit(dims).alias("dims")).write.mode("overwrite").parquet(f"{path}/index_meta")


def read_index(spark: SparkSession, path: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """SRC-5: (clusters, vectors); raises where version, dimensions or counts aren't as written."""
    meta = spark.read.parquet(f"{path}/index_meta").first()
    if meta is None or meta.version != VERSION or meta.dims != dims:
        raise ValueError(f"no index of version {VERSION} and {dims} dimensions in {path}: {meta}")
    clusters, vectors = spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/vectors")
    if clusters.count() != meta.k or vectors.count() != meta.n:
        raise ValueError(f"the index in {path} isn't whole")
    return clusters, vectors
