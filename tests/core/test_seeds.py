"""Seeds of a search: blocks of distances that bound every query by itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from tessera.operators import cells as C
from tessera.operators import exact


def test_seeds_are_blocks_that_bound_queries_one_by_one():
    v = np.random.default_rng(5).integers(0, 100, (600, 2)).astype(np.int16)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 2), pa.array(x.ravel()))
    cells = C.Cells(v.astype(float), 2)
    # two queries have one id
    query, cell = exact.asked(pa.Table.from_arrays([pa.array([7, 7, 8]), lists(v[:3])], names=["qid", "qv"]), 2, cells)
    refs = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), lists(v), pa.array(np.zeros(600, np.int32))], names=["ref_id", "v", "label"])
    parts = [list(exact._seeds(query, cell, cells, iter([b]), 5, False, 2)) for b in (refs.slice(0, 250), refs.slice(250))]
    assert all(b.num_rows <= 2 for p in parts for b in p)
    limit = {}
    for part in (0, 1):
        rows = [b.filter(pa.compute.equal(b.column("part"), part)) for p in parts for b in p]
        for b in exact._reached(iter(rows), 5):
            limit |= dict(zip(b.column("who").to_pylist(), b.column("dist").to_pylist(), strict=True))
    code = cells.of(v)
    for i in range(3):
        d = np.sort(((v[code == cell[i]].astype(int) - v[i]) ** 2).sum(axis=1))
        assert limit[i] == d[4]


def test_seeds_meet_few_references_of_their_cell(monkeypatch):
    """The nearest box of the cell comes first and most others aren't compared at all; none is met twice."""
    r = np.random.default_rng(6)
    v = r.integers(-10000, 10000, (20_000, 3)).astype(np.int16)
    v[500:520] = v[500]  # ties
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 3), pa.array(x.ravel()))
    cells = C.Cells(v.astype(float), 1)
    query, cell = exact.asked(pa.Table.from_arrays([pa.array(np.arange(100)), lists(v[450:550])], names=["qid", "qv"]), 3, cells)
    pairs, meet = [], exact.Best.meet
    monkeypatch.setattr(exact.Best, "meet", lambda self, who, v, *more: (pairs.append(len(who) * len(v)), meet(self, who, v, *more)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), lists(v), pa.array(np.zeros(len(v), np.int32))], names=["ref_id", "v", "label"])
    got = next(exact._seeds(query, cell, cells, iter([batch]), 5, False)).to_pandas()
    assert sum(pairs) < 100 * len(v) / 10
    code = cells.of(v)
    for i in range(100):
        mine = np.flatnonzero(code == cell[i])
        d = ((v[mine].astype(int) - v[450 + i]) ** 2).sum(axis=1)
        assert got[got.qid == i].sort_values(["dist", "ref_id"]).ref_id.tolist() == mine[np.lexsort((mine, d))[:5]].tolist()
