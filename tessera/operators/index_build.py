"""The inverted-file index: sample, centroids, assignment, boxes, order and its tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.vectors import round_to_smallint
from tessera.sources.shared import Scratch

#: Rows of what a table has in batches.
Opened = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
CLUSTERS, SAMPLE, ROUNDS, LANES, SEED = 4096, 50_000, 50, 8, 42
#: Most centroids that are held in every task.
MOST_CLUSTERS = 65_536
#: Distances to centroids that a task holds at once.
HELD = 1 << 18


def sample(refs: DataFrame, rows: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """IVF-1: the same rows each time: those with the smallest md5 of id and seed."""
    return refs.orderBy(F.md5(F.concat_ws("-", F.col("ref_id").cast("string"), F.lit(str(seed)))), "ref_id").limit(rows)


def _matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of centroids, in order of ids; their number is bounded."""
    rows = centroids.select("cluster_id", "centroid").orderBy("cluster_id").limit(MOST_CLUSTERS + 1).collect()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"over {MOST_CLUSTERS} centroids")
    return np.array([r.cluster_id for r in rows], dtype=np.int64), np.array([r.centroid for r in rows], dtype=np.float64)


def _closest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest centroids, the first of equals, and squared distances to them."""
    # the square of a vector is the same for all centroids: it is added to the least
    left, right = np.concatenate([v, np.ones((len(v), 1))], axis=1), np.concatenate([-2 * centroids, (centroids * centroids).sum(axis=1)[:, None]], axis=1).T
    best, dist, step = np.empty(len(v), dtype=np.int64), np.empty(len(v)), max(1, HELD // max(1, len(centroids)))
    for lo in range(0, len(v), step):
        d = left[lo : lo + step] @ right
        best[lo : lo + step] = d.argmin(axis=1)
        dist[lo : lo + step] = d[np.arange(len(d)), best[lo : lo + step]]
    return best, dist + np.einsum("ij,ij->i", v, v)


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        best, dist = _closest(v, centroids)
        extra = [pa.array(ids[best].astype(np.int32)), pa.array(dist)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "cluster_id", "dist"])


def assigning(centroids: DataFrame) -> Opened:
    """What assign() does to rows in a task."""
    ids, matrix = _matrix(centroids)
    return lambda batches: _nearest(batches, ids, matrix)


def assign(refs: DataFrame, centroids: DataFrame) -> DataFrame:
    """IVF-5, IVF-6: refs with the nearest centroid's cluster_id and the squared distance to it.  The centroids, which are
    few, go to the rows: no shuffle."""
    ids, matrix = _matrix(centroids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema.fields)
    return refs.mapInArrow(lambda batches: _nearest(batches, ids, matrix), f"{schema}, cluster_id int, dist double")


def _each(how: str, dims: int, of: str = "v") -> Column:
    """An aggregate of every dimension of `of`, as one array."""
    return F.expr("array(" + ", ".join(how.format(f"get({of}, {i})") for i in range(dims)) + ")")


def lloyd_step(refs: DataFrame, centroids: DataFrame, dims: int, opened: Opened | None = None) -> DataFrame:
    """IVF-3, IVF-4: (cluster_id, centroid array<double>) after one round; a cluster without members keeps its centroid.  Tasks add up their
    own members, so a row for each task and cluster is all that leaves them.  With `opened`, refs are blocks of them."""
    ids, matrix = _matrix(centroids)
    sums = (refs if opened else refs.select("v")).mapInArrow(lambda batches: _sums(opened(batches) if opened else batches, ids, matrix), "cluster_id int, n long, total array<long>")
    moved = sums.groupBy("cluster_id").agg(F.sum("n").alias("n"), _each("sum({})", dims, "total").alias("total"))
    mean = F.transform("total", lambda x: x.cast("double") / F.col("n"))
    old = centroids.select("cluster_id", F.transform("centroid", lambda x: x.cast("double")).alias("old"))
    return old.join(moved.select("cluster_id", mean.alias("mean")), "cluster_id", "left").select("cluster_id", F.coalesce("mean", "old").alias("centroid"))


def _sums(batches: Iterator[pa.RecordBatch], ids: np.ndarray, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbers and sums of the members of each centroid, of whole numbers."""
    n, total = np.zeros(len(ids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
    for batch in batches:
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        at = _closest(v.astype(np.float64), centroids)[0].astype(np.int32)
        order = np.argsort(at.astype(np.int16) if len(ids) < 1 << 15 else at, kind="stable")
        kinds, first = np.unique(at[order], return_index=True)
        if len(kinds):
            total[kinds] += np.add.reduceat(v[order], first, axis=0, dtype=np.int64)
        n += np.bincount(at, minlength=len(ids))
    filled = np.flatnonzero(n)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(filled) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[filled].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(ids[filled].astype(np.int32)), pa.array(n[filled]), lists], names=["cluster_id", "n", "total"])


def train(refs: DataFrame, dims: int, clusters: int = CLUSTERS, rows: int = SAMPLE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """IVF-1..4: (cluster_id, centroid array<double>) by Lloyd rounds over a bounded sample, from spread-out seeds.

    Seeds are drawn by squared distance to those drawn (k-means++) among the sample.  Centroids are a bounded table, so each
    round starts from values, not from the plan of the round before."""
    spark = refs.sparkSession
    drawn = sample(refs.select("ref_id", "v"), rows, seed).collect()  # bounded by `rows`
    points = np.array([r.v for r in drawn], dtype=np.float64).reshape(-1, dims)
    r, k = np.random.default_rng(seed), min(clusters, len(points))
    if not k:
        return spark.createDataFrame([], "cluster_id int, centroid array<double>")
    chosen = [int(r.integers(len(points)))]
    mass = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = mass.sum()
        chosen.append(int(r.choice(len(points), p=mass / total) if total > 0 else r.integers(len(points))))
        mass = np.minimum(mass, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    now = points[chosen].copy()
    last = None
    for _ in range(rounds):
        near = np.concatenate([((p * p).sum(axis=1)[:, None] - 2 * p @ now.T + (now * now).sum(axis=1)).argmin(axis=1) for p in np.array_split(points, max(1, len(points) // 4096))])
        if last is not None and np.array_equal(near, last):
            break
        last, n = near, np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, points[:, i], minlength=k) for i in range(dims)], axis=1)
        fresh = points[r.integers(len(points), size=k)]
        now = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], fresh)
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(now)], "cluster_id int, centroid array<double>")


def rounded(centroids: DataFrame) -> DataFrame:
    """IVF-11."""
    return centroids.select("cluster_id", F.transform("centroid", round_to_smallint).alias("centroid"))


def counts(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """IVF-7: (cluster_id, cnt), empty clusters included."""
    n = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cnt"))
    return centroids.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def first_sampled(refs: DataFrame, rows: int, seed: int = SEED) -> DataFrame:
    """IVF-1 of a few rows: only ids are sorted, vectors are read of those that are drawn."""
    drawn = sample(refs.select("ref_id"), rows, seed).collect()  # bounded by `rows`
    return sample(refs.where(F.col("ref_id").isin(sorted({r.ref_id for r in drawn}))), rows, seed)


def block_sample(blocks: DataFrame, opened: Opened, firsts: int, most: int, seed: int = SEED) -> tuple[int, list[list[int]], pa.Table]:
    """What the training of an index takes of blocks of vectors, in one pass: their number, first_sampled() of them, and some `most` rows (ref_id, v),
    the same each time."""
    n = int(blocks.select(F.coalesce(F.sum(F.length("ref_id") / 8), F.lit(0)).cast("long")).first()[0])
    every = max(1, n // most)
    rows = blocks.mapInArrow(lambda batches: _sampled(opened(batches), firsts, every, f"-{seed}"), "first boolean, ref_id long, v array<smallint>").toArrow()
    first = rows.filter(rows.column("first")).select(["ref_id", "v"]).to_pylist()  # bounded by tasks and `firsts`
    first.sort(key=lambda r: (hashlib.md5(f"{r['ref_id']}-{seed}".encode()).digest(), r["ref_id"]))
    return n, [r["v"] for r in first[:firsts]], rows.filter(pc.invert(rows.column("first"))).select(["ref_id", "v"]).slice(0, 2 * most).combine_chunks()


def _sampled(batches: Iterator[pa.RecordBatch], firsts: int, every: int, end: str) -> Iterator[pa.RecordBatch]:
    held: pa.RecordBatch | None = None
    for batch in batches:
        batch, ids = batch.select(["ref_id", "v"]), batch.column("ref_id").to_numpy()
        code = md5_start(ids, end)
        some = batch.take(pa.array(np.flatnonzero(code % np.uint64(every) == 0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(some.num_rows, dtype=bool)), *some.columns], names=["first", "ref_id", "v"])
        if firsts < len(code):
            batch = batch.take(pa.array(np.flatnonzero(code <= np.partition(code, firsts - 1)[firsts - 1])))
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if held.num_rows > 4 * firsts:
            code = md5_start(held.column("ref_id").to_numpy(), end)
            held = held.take(pa.array(np.flatnonzero(code <= np.partition(code, firsts - 1)[firsts - 1])))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(held.num_rows, dtype=bool)), *held.columns], names=["first", "ref_id", "v"])


_TURNS = np.repeat([(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)], 4, axis=0).ravel().tolist()
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def md5_start(ids: np.ndarray, end: str) -> np.ndarray:
    """The first eight bytes, as a number, of the md5 of each id in decimal with `end` behind it: whole blocks at once, as a call for each id takes
    several times as long."""
    if len(ids) and ids.min() < 0 or len(end) > 20:
        texts = [hashlib.md5(f"{i}{end}".encode()).digest() for i in ids.tolist()]
        return np.array([int.from_bytes(x[:8], "big") for x in texts], dtype=np.uint64)
    out = np.empty(len(ids), dtype=np.uint64)
    for lo in range(0, len(ids), 8192):
        out[lo : lo + 8192] = _md5_start(ids[lo : lo + 8192].astype(np.uint64), end.encode())
    return out


def _md5_start(ids: np.ndarray, end: bytes) -> np.ndarray:
    text, size = np.zeros((len(ids), 64), dtype=np.uint8), np.ones(len(ids), dtype=np.int64)
    digits, rest = np.empty((len(ids), 20), dtype=np.uint8), ids
    for i in range(19, -1, -1):
        rest, digits[:, i] = rest // np.uint64(10), rest % np.uint64(10)
        size[rest > 0] += 1
    for n in np.unique(size).tolist():
        mine = size == n
        text[mine, :n] = digits[mine, 20 - n :] + np.uint8(48)
        text[mine, n : n + len(end)] = np.frombuffer(end, dtype=np.uint8)
        text[mine, n + len(end)] = 128
    words = np.ascontiguousarray(text.view("<u4").T)
    words[14] = (size + len(end)) * 8
    a, b, c, d = (np.full(len(ids), x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, at = (b & c) | (~b & d), i
        elif i < 32:
            f, at = (d & b) | (~d & c), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        f += words[at]
        turned = (f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i]))
        a, d, c, b = d, c, b, b + turned
    a, b = (a + np.uint32(0x67452301)).byteswap(), (b + np.uint32(0xEFCDAB89)).byteswap()
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def block_offsets(counted: DataFrame, lanes: int = LANES) -> DataFrame:
    """IVF-8: first block of each cluster; a row for each cluster, so one window is bounded."""
    before = W.orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1)
    return counted.select("cluster_id", "cnt", _block_start(before, lanes).alias("block_start"))


def _block_start(before: WindowSpec, lanes: int = LANES) -> Column:
    return F.coalesce(F.sum(F.ceil(F.col("cnt") / lanes).cast("long")).over(before), F.lit(0).cast("long"))


def _members(assigned: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, n, lo, hi) of filled clusters in one pass.  A row for each task and cluster leaves the tasks."""
    ends = assigned.select("cluster_id", "v").mapInArrow(_ends, "cluster_id int, n long, low array<smallint>, high array<smallint>")
    return ends.groupBy("cluster_id").agg(F.sum("n").alias("n"), _each("min({})", dims, "low").alias("lo"), _each("max({})", dims, "high").alias("hi"))


def _boxed(dims: int) -> list[Column]:
    zero = F.array_repeat(F.lit(0).cast("smallint"), dims)
    return [F.coalesce("lo", zero).alias("bbox_min"), F.coalesce("hi", zero).alias("bbox_max")]


def boxes(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """IVF-12: (cluster_id, bbox_min, bbox_max); an empty cluster's box is 0."""
    return centroids.select("cluster_id").join(_members(assigned, dims), "cluster_id", "left").select("cluster_id", *_boxed(dims))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, least and greatest of every dimension of each cluster's members."""
    held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        cluster, v = batch.column("cluster_id").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if (cluster[1:] < cluster[:-1]).any():
            order = np.argsort(cluster, kind="stable")
            cluster, v = cluster[order], v[order]
        kinds, first, n = np.unique(cluster, return_index=True, return_counts=True)
        for kind, rows, low, high in zip(kinds.tolist(), n.tolist(), np.minimum.reduceat(v, first, axis=0), np.maximum.reduceat(v, first, axis=0), strict=True):
            before = held.get(kind, (0, low, high))
            held[kind] = before[0] + rows, np.minimum(before[1], low), np.maximum(before[2], high)
    if held:
        lists = [pa.array([x[i].tolist() for x in held.values()], type=pa.list_(pa.int16())) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.int32()), pa.array([x[0] for x in held.values()], type=pa.int64()), *lists], names=["cluster_id", "n", "low", "high"])


def cluster_order(assigned: DataFrame, lanes: int = LANES) -> DataFrame:
    """IVF-9, IVF-10, IVF-13: block and lane of each vector in its cluster, the nearest to the centroid first.  Vectors are dealt by range of
    cluster and distance, so a hot cluster is split; places are counted in each range and go on from the ranges before."""
    spark, path = assigned.sparkSession, Scratch.of(assigned.sparkSession).folder("order")
    by = ["cluster_id", "dist", "ref_id"]
    assigned.select(*by).repartitionByRange(*by).withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    place = F.row_number().over(W.partitionBy("cluster_id", "part").orderBy("dist", "ref_id")) - 1
    n = dealt.groupBy("cluster_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("cluster_id", "part", (F.sum("n").over(W.partitionBy("cluster_id").orderBy("part")) - F.col("n")).alias("before"))
    placed = dealt.withColumn("place", place).join(before, ["cluster_id", "part"]).withColumn("place", F.col("place") + F.col("before"))
    return placed.select("cluster_id", "ref_id", F.floor(F.col("place") / lanes).cast("int").alias("block"), (F.col("place") % lanes).cast("int").alias("lane"))


def lloyd(refs: DataFrame, centroids: DataFrame, dims: int, rounds: int, opened: Opened | None = None) -> DataFrame:
    """IVF-3: some rounds over all refs from given centroids, rounded after each; they are a bounded table, so each round starts from values."""
    spark = refs.sparkSession
    for _ in range(rounds):
        moved = rounded(lloyd_step(refs, centroids, dims, opened))
        centroids = spark.createDataFrame(moved.orderBy("cluster_id").limit(MOST_CLUSTERS).collect(), "cluster_id int, centroid array<smallint>")
    return centroids


def train_ml(refs: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """IVF-2, IVF-3 by Spark's own KMeans, over all refs: (cluster_id, centroid array<double>)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = refs.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=clusters, maxIter=rounds, seed=seed, initMode="k-means||").fit(rows)
    return refs.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centroid array<double>")


def cluster_table(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, cnt, block_start, centroid, bbox_min, bbox_max), in one pass over the vectors."""
    every = centroids.select("cluster_id", "centroid").join(_members(assigned, dims), "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0).cast("long")).alias("cnt"), "centroid", *_boxed(dims))
    before = W.orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1)
    return every.select("cluster_id", "cnt", _block_start(before).alias("block_start"), "centroid", "bbox_min", "bbox_max")
