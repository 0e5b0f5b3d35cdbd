"""Blocks of vectors, and what an index takes of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import features
from tessera.operators import index_build
from tessera.plans import views

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("end", ["-42", "-7"])
def test_md5_of_many_ids_at_once(end):
    ids = np.array([0, 7, 10, 99, 12345, 10**17 + 3, 2**63 - 1, 2**62], dtype=np.int64)
    ids = np.concatenate([ids, np.random.default_rng(1).integers(0, 2**63 - 1, 9000)])
    want = [int.from_bytes(hashlib.md5(f"{i}{end}".encode()).digest()[:8], "big") for i in ids.tolist()]
    assert index_build.md5_start(ids, end).tolist() == want
    assert index_build.md5_start(np.array([-5]), end).tolist() == [int.from_bytes(hashlib.md5(f"-5{end}".encode()).digest()[:8], "big")]


def test_blocks_have_the_rows(spark, monkeypatch):
    tx = views._tx_labelled(spark, SF_DIR)
    rows = sorted((r.ref_id, r.label, list(r.v)) for r in views.tx_refs(spark, SF_DIR).collect())
    blocks = features.vector_blocks(tx, "ref_id", "label")
    got = pa.Table.from_batches(features.opened(iter(blocks.toArrow().to_batches()))).to_pylist()
    assert sorted((r["ref_id"], r["label"], r["v"]) for r in got) == rows
    n, first, some = index_build.block_sample(blocks, features.opened, 64, 1000)
    assert n == len(rows) and first == [list(r.v) for r in index_build.first_sampled(views.tx_refs(spark, SF_DIR), 64).collect()]
    assert 500 < some.num_rows <= 2000 and {(r["ref_id"], tuple(r["v"])) for r in some.to_pylist()} <= {(i, tuple(v)) for i, _, v in rows}
