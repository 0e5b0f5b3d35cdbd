"""Exact k nearest neighbours, votes and scores.

Two ways to the same rows.  `blocks` (the default) sends queries of a checked size to every partition of
the references, where queries meet only the boxes of references that are nearer than their k nearest so far, distances of a
block of either are one matrix product and only the k best leave; a first pass over the cell that a query falls in
says how near that is.  `columns` is one Catalyst plan with unrolled distances.  Ties go to the smaller reference id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.vectors import squared_l2
from tessera.operators.cells import Boxes, Cells, blocks, chunks, flat, learnt
from tessera.sources.shared import Scratch

K = 5
#: Most bytes of queries sent to every executor at once; more queries go in several rounds, one after another.
QUERY_BYTES = 128 << 20
#: Distances that a task holds at once (doubles), whatever the number of queries.
PAIRS = 1 << 20
#: References compared with queries at once.
BLOCK_ROWS = 2048
#: Queries that are held against a box at once.
NEAR_ROWS = 4096
#: Largest sum of squared differences that doubles hold exactly.
EXACT = 2**53

#: No cells, where there is nothing to find.
ONE = Cells(np.zeros((0, 1)), 0)
_FOUND = "qid long, dist long, ref_id long, label int"


@dataclass
class Asked:
    """Queries as they go to the references: `who` has the numbers of those that ask in clusters[i] from starts[i] to starts[i + 1], by their
    cell; without clusters all of them ask everywhere."""

    queries: np.ndarray
    qids: np.ndarray
    #: What each of k nearest is at least as near as.
    limit: np.ndarray
    who: np.ndarray
    clusters: np.ndarray | None = None
    starts: np.ndarray | None = None

    def of(self, cluster: np.ndarray | None, rows: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """Queries, and the rows of a chunk that they ask for."""
        if self.clusters is None or cluster is None:
            yield self.who, 0, rows
            return
        cut = np.flatnonzero(cluster[1:] != cluster[:-1]) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), rows], strict=True):
            at = int(np.searchsorted(self.clusters, cluster[lo]))
            if at < len(self.clusters) and self.clusters[at] == cluster[lo]:
                yield self.who[self.starts[at] : self.starts[at + 1]], lo, hi


def asked(rows: pa.Table, dims: int, cells: Cells, limit: np.ndarray | None = None) -> tuple[Asked, np.ndarray]:
    """Rows (qid, qv and, if they don't ask everywhere, clusters) and the cell of each."""
    rows = rows.combine_chunks()
    m, qids = matrix(rows, "qv", dims), rows.column("qid").to_numpy()
    if np.abs(m).max(initial=0) < 1 << 24:
        m = m.astype(np.float32)  # these are whole there
    cell = cells.of(m)
    limit = np.full(len(m), np.inf) if limit is None else limit
    if "clusters" not in rows.column_names:
        return Asked(m, qids, limit, np.argsort(cell, kind="stable").astype(np.int32)), cell
    lists = rows.column("clusters").combine_chunks()
    if not len(m):
        return Asked(m, qids, limit, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)), cell
    cluster = lists.flatten().to_numpy(zero_copy_only=False)
    who = np.repeat(np.arange(len(m), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    order = np.lexsort((cell[who], cluster))
    kinds, first = np.unique(cluster[order], return_index=True)
    return Asked(m, qids, limit, who[order], kinds, np.append(first, len(order))), cell


def gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from queries, a row for each dimension, to a box."""
    gap = np.maximum(q, low.astype(q.dtype)[:, None])
    np.minimum(gap, high.astype(q.dtype)[:, None], out=gap)
    gap -= q
    gap *= gap
    return gap.sum(axis=0)


class Best:
    """The k nearest references so far of every query."""

    def __init__(self, queries: np.ndarray, qids: np.ndarray, k: int, skip_self: bool, limit: np.ndarray | None = None):
        self.queries, self.qids, self.k, self.skip_self = queries, qids, k, skip_self
        self.dist = np.full((len(qids), k), np.inf)
        self.ref, self.label = np.zeros((len(qids), k), dtype=np.int64), np.zeros((len(qids), k), dtype=np.int32)
        #: What is farther than this isn't one of the k nearest.
        self.worst = np.full(len(qids), np.inf) if limit is None else limit.copy()

    def columns(self, who: np.ndarray) -> np.ndarray:
        """Queries with a row for each dimension: boxes are held against many of them at once."""
        return np.ascontiguousarray(self.queries[who].T)

    def near(self, who: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a box may hold one of the nearest of `who`, whose columns are q; the bound may be a little too small, never too large."""
        out = np.empty(len(who), dtype=bool)
        for lo in range(0, len(who), NEAR_ROWS):
            part = slice(lo, lo + NEAR_ROWS)
            out[part] = gaps(q[:, part], low, high) * (1 - 1e-5) <= self.worst[who[part]]
        return out

    def own(self, who: np.ndarray, v: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Queries `who` meet the references of their cell, those of the nearest box first."""
        boxes, q = Boxes(v), self.columns(who)
        v, ids, labels = v[boxes.order], ids[boxes.order], labels[boxes.order]
        leaves = [(lo, hi, low, high) for at, (lo, hi, low, high, after) in enumerate(boxes.nodes) if after == at + 1]
        first, least = np.zeros(len(who), dtype=np.int64), np.full(len(who), np.inf)
        for lo, _, low, high in leaves:
            gap = gaps(q, low, high)
            nearer = gap < least
            first[nearer], least[nearer] = lo, gap[nearer]

        def leaf(who: np.ndarray, q: np.ndarray, lo: int, hi: int) -> None:
            for a in range(lo, hi, BLOCK_ROWS):
                part = slice(a, min(a + BLOCK_ROWS, hi))
                self.meet(who, v[part], ids[part], labels[part], q)

        for lo, hi, *_ in leaves:
            if len(mine := np.flatnonzero(first == lo)):
                leaf(who[mine], q[:, mine], lo, hi)

        def other(at: np.ndarray, q: np.ndarray, rows: slice) -> None:
            if not (new := first[at] != rows.start).all():  # none is met twice
                at, q = at[new], q[:, new]
            if len(at):
                leaf(who[at], q, rows.start, rows.stop)

        boxes.meet(np.arange(len(who)), q, lambda at, q, low, high: self.near(who[at], q, low, high), other)

    def meet(self, who: np.ndarray, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray | None = None) -> None:
        """Queries `who` (q: their columns, if they are at hand) meet a few references."""
        v = v.astype(np.float64)
        # with the squares of either side as two more dimensions a distance is one product
        right = np.concatenate([v, (v * v).sum(axis=1)[:, None], np.ones((len(v), 1))], axis=1).T
        step = max(1, PAIRS // max(len(v), 1))
        for lo in range(0, len(who), step):
            part = who[lo : lo + step]
            self._merge(part, self.queries[part].T if q is None else q[:, lo : lo + step], right, ids, labels)

    def _merge(self, who: np.ndarray, q: np.ndarray, right: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        q = q.astype(np.float64)
        d = np.concatenate([-2 * q, np.ones((1, len(who))), (q * q).sum(axis=0)[None]]).T @ right
        if self.skip_self:
            d[self.qids[who][:, None] == ids] = np.inf
        worst = self.worst[who]
        if d.shape[1] > self.k and (fresh := np.flatnonzero(np.isinf(worst))).size:
            worst[fresh] = np.partition(d[fresh], self.k - 1, axis=1)[:, self.k - 1]
        near = np.flatnonzero(d <= np.minimum(worst, np.finfo(float).max)[:, None])
        if not len(near):
            return
        row, col = np.divmod(near, d.shape[1])
        some = np.unique(row)
        own = who[some]
        at = np.concatenate([np.searchsorted(some, row), np.repeat(np.arange(len(some)), self.k)])
        dist, ref, label = (np.concatenate([new, old[own].ravel()]) for new, old in ((d.ravel()[near], self.dist), (ids[col], self.ref), (labels[col], self.label)))
        order = np.lexsort((ref, dist, at))
        first = np.searchsorted(at[order], np.arange(len(some)))
        pick = order[first[:, None] + np.arange(self.k)]  # each has k old ones at least
        self.dist[own], self.ref[own], self.label[own] = dist[pick], ref[pick], label[pick]
        self.worst[own] = np.minimum(self.worst[own], self.dist[own, -1])

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.dist))
        return pa.RecordBatch.from_arrays([pa.array(self.qids[row]), pa.array(self.dist[row, col].astype(np.int64)), pa.array(self.ref[row, col]), pa.array(self.label[row, col])], names=["qid", "dist", "ref_id", "label"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    for rows in chunks(batches):
        if rows.num_rows:
            column = lambda name: rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            yield flat(rows.column("v").combine_chunks()), column("ref_id"), column("label").astype(np.int32), column("cluster_id") if "cluster_id" in rows.column_names else None


def _best(query: Asked, batches: Iterator[pa.RecordBatch], k: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """The k nearest references of this partition for every query."""
    best = Best(query.queries, query.qids, k, skip_self, query.limit)
    every = None
    for v, ids, labels, cluster in _read(batches):
        for who, lo, hi in query.of(cluster, len(v)):
            mine = v[lo:hi]
            if who is query.who:  # all of them, at every chunk
                q = every = best.columns(who) if every is None else every
            else:
                q = best.columns(who)
            near = np.flatnonzero(best.near(who, q, mine.min(axis=0), mine.max(axis=0)))
            if not len(near):
                continue
            boxes = Boxes(mine)
            mine, own_ids, own_labels = mine[boxes.order], ids[lo:hi][boxes.order], labels[lo:hi][boxes.order]

            def leaf(who: np.ndarray, q: np.ndarray, rows: slice, mine=mine, ids=own_ids, labels=own_labels) -> None:
                for a in range(rows.start, rows.stop, BLOCK_ROWS):
                    part = slice(a, min(a + BLOCK_ROWS, rows.stop))
                    best.meet(who, mine[part], ids[part], labels[part], q)

            boxes.meet(who[near], q.take(near, axis=1), best.near, leaf)
    yield best.rows()


def _seeds(query: Asked, cell: np.ndarray, cells: Cells, batches: Iterator[pa.RecordBatch], k: int, skip_self: bool, parts: int = 0) -> Iterator[pa.RecordBatch]:
    """Distances of the k nearest references of this partition that are in a query's own cell, in a block for each part of the queries;
    without parts, the references as rows."""
    best = Best(query.queries, query.qids, k, skip_self)
    for v, ids, labels, cluster in _read(batches):
        for who, lo, hi in query.of(cluster, len(v)):
            code = cells.of(v[lo:hi])
            order = np.argsort(code, kind="stable")
            kinds, first = np.unique(code[order], return_index=True)
            ends, theirs = np.append(first[1:], len(order)), cell[who]
            left, right = np.searchsorted(theirs, kinds, "left"), np.searchsorted(theirs, kinds, "right")
            for i in np.flatnonzero(left < right).tolist():
                rows = lo + order[first[i] : ends[i]]
                best.own(who[left[i] : right[i]], v[rows], ids[rows], labels[rows])
    if not parts:
        yield best.rows()
        return
    some = np.flatnonzero(np.isfinite(best.dist[:, 0])).astype(np.int32)
    some = some[np.argsort(some % parts, kind="stable")]
    if len(some):
        kinds, first = np.unique(some % parts, return_index=True)
        ends = np.append(first, len(some))
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), blocks(some, ends), blocks(best.dist[some], ends)], names=["part", "who", "dist"])


def _reached(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Numbers of queries for which k references were found, and the distance of the k-th."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held += [(np.frombuffer(who.as_buffer(), dtype=np.int32), np.frombuffer(dist.as_buffer())) for who, dist in zip(batch.column("who"), batch.column("dist"), strict=True)]
    if not held:
        return
    who, dist = np.repeat(np.concatenate([x for x, _ in held]), k), np.concatenate([x for _, x in held])
    order = np.lexsort((dist, who))
    who, dist = who[order], dist[order]
    kinds, first = np.unique(who, return_index=True)
    limit = dist[first + k - 1]  # each has k at least, some of them infinite
    known = np.isfinite(limit)
    yield pa.RecordBatch.from_arrays([pa.array(kinds[known]), pa.array(limit[known])], names=["who", "dist"])


def found(refs: DataFrame, rows: pa.Table, dims: int, cells: Cells, k: int, skip_self: bool, limit: np.ndarray | None = None) -> DataFrame:
    """The k nearest of rows (qid, qv, clusters or none) among refs (ref_id, v, label, cluster_id or none), and some more.  `limit` has a distance for
    each row that its k-th nearest isn't beyond; without it a first pass over the cells finds one."""
    query, cell = asked(rows, dims, cells, limit)
    if not len(query.qids):
        return refs.sparkSession.createDataFrame([], _FOUND)
    if limit is None and cells.depth:
        parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        seeds = refs.mapInArrow(lambda batches: _seeds(query, cell, cells, batches, k, skip_self, parts), "part int, who binary, dist binary")
        reached = seeds.repartition(parts, "part").mapInArrow(lambda batches: _reached(batches, k), "who int, dist double").toArrow()  # a row a query at most
        limit = np.full(len(query.qids), np.inf)
        limit[np.asarray(reached.column("who"))] = np.asarray(reached.column("dist"))
        query.limit = limit
    return refs.mapInArrow(lambda batches: _best(query, batches, k, skip_self), _FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, ref_id, dist, label) of the k nearest of what was found for each query."""
    near = W.partitionBy("qid").orderBy("dist", "ref_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("qid", "rank", "ref_id", "dist", "label")


def rows_a_round(dims: int, clusters: int = 0) -> int:
    """Queries whose vectors (single precision), ids, limits and clusters are of a checked size."""
    return max(1, QUERY_BYTES // (4 * (dims + 6 + clusters)))


def in_rounds(queries: DataFrame, dims: int, name: str, one: Callable[[DataFrame, pa.Table], DataFrame], clusters: int = 0) -> DataFrame:
    """The rows that `one` finds for queries (qid, qv), of which a checked number goes at once.  Several rounds run one after another, each
    written before the next one's queries are collected."""
    most = rows_a_round(dims, clusters)
    few = queries.limit(most + 1).toArrow()
    if few.num_rows <= most:
        return one(queries, few)
    rounds = -(-queries.count() // most) + 1
    path = Scratch.of(queries.sparkSession).folder(name)
    for i in range(rounds):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == i)
        one(part, part.toArrow()).write.mode("append").parquet(path)
    return queries.sparkSession.read.parquet(path)


def matrix(rows: pa.Table, column: str, dims: int) -> np.ndarray:
    """Vectors of a table, as doubles in which distances are exact."""
    if not rows.num_rows:
        return np.zeros((0, dims))
    out = np.asarray(rows.combine_chunks().column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)).astype(np.float64).reshape(-1, dims)
    if np.abs(out).max(initial=1) ** 2 * 4 * dims >= EXACT:
        raise ValueError("values too large for exact distances")
    return out


def nearest(refs: DataFrame, queries: DataFrame, dims: int, k: int = K, skip_self: bool = False, way: str = "blocks") -> DataFrame:
    """KNN-4: (qid, rank, ref_id, dist, label) of the k nearest references (ref_id, v, label) of each query (qid, v).

    `skip_self` leaves out the reference whose id is the query's.  Fewer references give fewer rows.
    """
    refs = refs.select(F.col("ref_id").cast("long").alias("ref_id"), "v", F.col("label").cast("int").alias("label"))
    queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("v").alias("qv"))
    cells = functools.cache(lambda: learnt(refs, dims))

    def one(part: DataFrame, rows: pa.Table) -> DataFrame:
        if way == "blocks":
            return ranked(found(refs, rows, dims, cells() if rows.num_rows else ONE, k, skip_self), k)
        pairs = refs.crossJoin(F.broadcast(part))  # of the size that in_rounds() has checked
        pairs = pairs.where("qid <> ref_id") if skip_self else pairs
        return ranked(pairs.select("qid", squared_l2("qv", "v", dims).alias("dist"), "ref_id", "label"), k)

    return in_rounds(queries, dims, "nearest", one)


def vote(top: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """KNN-6: (qid, fraud_count, found, worst): labels of the k nearest; slots that stay empty count 0; worst is the
    k-th distance, null if fewer were found."""
    by_query = top.groupBy("qid").agg(F.sum("label").cast("int").alias("c"), F.count(F.lit(1)).cast("int").alias("n"), F.max("dist").alias("w"))
    joined = queries.select("qid").join(by_query, "qid", "left")
    return joined.select("qid", F.coalesce("c", F.lit(0)).alias("fraud_count"), F.coalesce("n", F.lit(0)).alias("found"), F.when(F.col("n") >= k, F.col("w")).alias("worst"))
