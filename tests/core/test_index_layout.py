"""The index is laid out in one pass over its vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import cells as C
from tessera.operators import index_build, index_search
from tessera.sources import index as I


def _refs(spark, n, dims):
    v = np.random.default_rng(3).integers(-50, 50, (n, dims)).tolist()
    return spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(v)], "ref_id long, v array<smallint>, label int"), np.array(v)


def test_written_index_has_every_vector_and_vectors_are_run_once(spark, tmp_path):
    refs, v = _refs(spark, 3000, 3)
    cent = spark.createDataFrame([(i, v[i].tolist()) for i in range(4)] + [(4, [9999] * 3)], "cluster_id int, centroid array<smallint>")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n, some = C.drawn(refs)
    some = index_build.assign(spark.createDataFrame(some), cent).toArrow()
    assigned = index_build.assign(refs.mapInArrow(count, refs.schema), cent)
    path = f"file://{tmp_path}/index"
    I.write_index(path, lambda vectors: index_build.cluster_table(vectors, cent, 3), assigned, 3, partitions=7, sample=(n, some))
    assert seen.value == 3000
    clusters, vectors = I.read_index(spark, path, 3)
    near = ((v[:, None].astype(int) - v[None, :4]) ** 2).sum(axis=2).argmin(axis=1)
    assert {r.ref_id: (list(r.v), r.label, r.cluster_id) for r in vectors.collect()} == {i: (v[i].tolist(), i % 2, near[i]) for i in range(3000)}
    rows = clusters.orderBy("cluster_id").collect()
    assert [r.cnt for r in rows] == [*np.bincount(near, minlength=4), 0] and list(rows[4].bbox_min) == [0, 0, 0]
    assert all(list(r.bbox_min) == v[near == r.cluster_id].min(axis=0).tolist() and list(r.bbox_max) == v[near == r.cluster_id].max(axis=0).tolist() for r in rows[:4])
    found = index_search.search(refs.where("ref_id < 40").select(F.col("ref_id").alias("qid"), "v"), clusters, vectors, 3, probes=1, low=0, high=5).collect()
    d = np.sort(((v[:40, None].astype(int) - v[None]) ** 2).sum(axis=2), axis=1)
    assert {r.qid: r.worst for r in found} == {i: d[i, 4] for i in range(40)}


def test_first_sampled_is_the_sample(spark):
    refs, _ = _refs(spark, 500, 3)
    assert [r.ref_id for r in index_build.first_sampled(refs, 20).collect()] == [r.ref_id for r in index_build.sample(refs, 20).collect()]
