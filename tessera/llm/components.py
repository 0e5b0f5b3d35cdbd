"""Connected components of an edge table by alternating stars.

Edges first shrink to a spanning forest inside each partition.  Then each round points every
node's larger neighbours to its smallest one (large star) and its smaller neighbours and
itself to their smallest (small star), until every tree is a star around its smallest node.
Groups are never gathered: the minima are aggregated before the shuffle, and the join that
deals a hub's edges can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import Tables

MOST_ROUNDS = 100


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (larger, smallest) with the components of the given edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        lo, hi = np.minimum(rx, ry)[differ], np.maximum(rx, ry)[differ]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


class Forest:
    """Edges of one partition, kept as a spanning forest of at most twice its size."""

    def __init__(self) -> None:
        self.a = self.b = np.zeros(0, dtype=np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.n += len(a)
        if self.n > max(len(self.a), 100_000):
            self.edges()

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self.a, self.b = forest(*(np.concatenate([own, *(x[i] for x in self.held)]) for i, own in enumerate((self.a, self.b))))
            self.held, self.n = [], 0
        return self.a, self.b


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's edges, two long columns without nulls, as a spanning forest."""
    out = Forest()
    for batch in batches:
        out.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out.edges()], names=["a", "b"])


def components(edges: DataFrame, tables: Tables, shrunk: bool = False) -> DataFrame:
    """(node, root) for every node of `edges` (two long columns) that isn't the smallest of its
    component, root being that smallest node.  Rows with a null end are no edges.  An empty
    edge table gives an empty result.  `shrunk`: partitions are local_forest()s as they come."""
    a, b = edges.columns
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now, path = tables.write((pairs if shrunk else pairs.mapInArrow(local_forest, "a long, b long")).distinct())
    for _ in range(MOST_ROUNDS):
        # a star forest: every node stands once on the left and never on the right
        seen = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        deep = now.select("b").distinct().join(seen.select(F.col("a").alias("b")), "b", "left_semi")
        if seen.where("n > 1").isEmpty() and deep.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima as tables, not as aggregates under the joins: a hub's edges can then be split
        least, least_path = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, large_path = tables.write(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after, old = tables.write(small.select("e.a", "e.b").where("a <> b").distinct()), path
        now, path = after
        for done in (old, least_path, large_path):
            tables.drop(done)
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
