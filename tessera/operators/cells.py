"""Places of vectors: cells of all of them, by which they are laid out and queries find a first answer, and boxes in a task.

Neither changes a result: what a box can't hold, as it is farther from a query than the k nearest so far, isn't compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a cell, as far as MOST_DEPTH halvings go, and rows of the sample that cells are learnt from.
CELL_ROWS, MOST_DEPTH, SAMPLE = 8192, 12, 65_536
#: Rows of which a task makes boxes at once, and rows of the smallest box.
CHUNK, LEAF = 65_536, 256


class Cells:
    """A binary tree that halves the sample again and again, in the dimension in which it varies most."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.cut = np.zeros(1 << depth, dtype=np.int64), np.full(1 << depth, np.inf)
        rows = {1: np.arange(len(points))}
        for node in range(1, 1 << depth):
            mine = rows.pop(node)
            right = np.zeros(len(mine), dtype=bool)
            if len(mine) > 1:
                own = points[mine]
                self.dim[node] = own.var(axis=0).argmax()
                x = own[:, self.dim[node]]
                middle = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
                self.cut[node] = middle if middle < x.max() else x[x < middle].max(initial=-np.inf)
                right = x > self.cut[node]
            if 2 * node < 1 << depth:
                rows[2 * node], rows[2 * node + 1] = mine[~right], mine[right]

    def of(self, v: np.ndarray) -> np.ndarray:
        node, row = np.ones(len(v), dtype=np.int64), np.arange(len(v))
        for _ in range(self.depth):
            node = 2 * node + (v[row, self.dim[node]] > self.cut[node])
        return (node - (1 << self.depth)).astype(np.int32)


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows ends[i] to ends[i + 1] of x as bytes, for each i."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * (x.nbytes // len(x))).astype(np.int32)), pa.py_buffer(x)])


def drawn(refs: DataFrame) -> tuple[int, pa.Table]:
    """How many refs (ref_id, v) there are, and a bounded sample of them: the same each time."""
    n = refs.count()
    return n, refs.where(F.pmod(F.xxhash64("ref_id"), F.lit(max(1, n // SAMPLE))) == 0).select("ref_id", "v").limit(2 * SAMPLE).toArrow().combine_chunks()


def cells_of(n: int, rows: pa.Table, dims: int) -> Cells:
    """Cells of n refs, from a sample of them.  Few refs are one cell."""
    depth = min(MOST_DEPTH, (n // CELL_ROWS).bit_length())
    return Cells(flat(rows.column("v").combine_chunks()).astype(np.float64) if depth and rows.num_rows else np.zeros((0, dims)), depth)


def learnt(refs: DataFrame, dims: int) -> Cells:
    """Cells of refs (ref_id, v)."""
    return cells_of(*drawn(refs), dims)


class Boxes:
    """Rows halved down to LEAF of them, each node with its box; `order` has the rows of a node side by side."""

    def __init__(self, v: np.ndarray):
        self.order = np.arange(len(v))
        self.nodes: list[tuple[int, int, np.ndarray, np.ndarray, int]] = []  # first and last row, box, and the node after those inside
        if len(v):
            self._add(v, 0, len(v))

    def _add(self, v: np.ndarray, lo: int, hi: int) -> None:
        own = v[self.order[lo:hi]]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.nodes)
        self.nodes.append((lo, hi, low, high, 0))
        if hi - lo > LEAF and (high > low).any():
            middle = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, (high - low).argmax()], middle)]
            self._add(v, lo, lo + middle)
            self._add(v, lo + middle, hi)
        self.nodes[at] = (lo, hi, low, high, len(self.nodes))

    def meet(self, who: np.ndarray, q: np.ndarray, near: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], leaf: Callable[[np.ndarray, np.ndarray, slice], None]) -> None:
        """Queries `who`, whose values are q (a row for each dimension), go down to the boxes that `near` them; `leaf` gets them with the places in `order`.
        Their values go along, as picking them anew from all queries would cost more than the bounds."""
        stack = [(0, who, q)] if self.nodes else []
        while stack:
            node, mine, q = stack.pop()
            lo, hi, low, high, after = self.nodes[node]
            near_by = np.flatnonzero(near(mine, q, low, high))
            if not len(near_by):
                continue
            if len(near_by) < len(mine):
                mine, q = mine[near_by], q.take(near_by, axis=1)
            if after == node + 1:
                leaf(mine, q, slice(lo, hi))
            else:
                left = node + 1
                stack += [(self.nodes[left][4], mine, q), (left, mine, q)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Some CHUNK rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
