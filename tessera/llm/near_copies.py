"""Near copies by the Jaccard similarity of their sets of shingles.

SimHash (simhash.py) brings together documents whose fingerprints differ in few bits; as a similarity of 0.8 is some 10 of 64 bits, minima of
the hashed shingles, in bands, bring together those it can't see.  What shares a SimHash group or a
band is verified on the whole sets, so every link is exact.  Two documents of similarity s share
none of the bands with a chance of (1 - s^ROWS)^BANDS: 3 in 100,000 at 0.8, less above.  Equal sets
collapse first, bands with the same members count once, only texts in shared bands are read again, and a
band yields a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._tables import Tables, without
from tessera.llm.components import components, local_forest
from tessera.llm.simhash import _shingles, fingerprints, grouped

U64 = np.uint64
BANDS, ROWS = 20, 4
#: Bits in which SimHash fingerprints may differ.
DISTANCE = 3
_SALTS = T.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U64))


def shingle_sets(block: T.Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's different shingles, in order, and each document's first (one more at the end)."""
    text, starts, ends, n = _shingles(block, words)
    h = T.span_hashes(T.byte_prefix(np.frombuffer(text, dtype=np.uint8)), starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Equal for equal sets; 0 for the empty one."""
    out = np.zeros(len(first) - 1, dtype=U64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = T.mix(np.add.reduceat(T.mix(h ^ U64(T.WORD_BASE)), first[some]))
    return out


def bands(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys (documents, BANDS) of sets that aren't empty."""
    keys = np.zeros((len(first) - 1, BANDS), dtype=U64)
    for k in range(BANDS):
        for j in range(k * ROWS, (k + 1) * ROWS):
            least = np.minimum.reduceat((h ^ _SALTS[2 * j]) * (_SALTS[2 * j + 1] | U64(1)), first[:-1])
            keys[:, k] = T.mix(keys[:, k] * U64(T.BYTE_BASE) + least)
    return keys


def _mark(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, flat, size = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
            for block in T.blocks(batch.column(1)):
                h, first = shingle_sets(block, words)
                some = np.diff(first) > 0
                fp.append(digests(h, first))
                if some.any():
                    flat.append(bands(h, np.append(first[:-1][some], first[-1])).ravel())
                size.append(some * BANDS)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(size))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fp).view(np.int64)), keys], names=["doc_id", "fp", "keys"])

    return run


def linked(h: np.ndarray, first: np.ndarray, least: tuple[int, int]) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among sets: a search from each in turn over those not yet reached."""
    size, a, b = np.diff(first), [], []
    left = np.arange(len(size))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            mine = h[first[x] : first[x + 1]]
            fit = np.flatnonzero(np.minimum(size[left], len(mine)) * least[1] >= np.maximum(size[left], len(mine)) * least[0])
            if not len(fit):
                continue
            many = left[fit]
            start = np.cumsum(size[many]) - size[many]
            at = np.arange(size[many].sum()) + np.repeat(first[many] - start, size[many])
            found = np.searchsorted(mine, h[at])
            both = np.add.reduceat((mine[np.minimum(found, len(mine) - 1)] == h[at]).astype(np.int64), start)
            near = both * least[1] >= (size[many] + len(mine) - both) * least[0]
            new = many[near].tolist()
            a.extend([x] * len(new))
            b.extend(new)
            queue.extend(new)
            left = np.delete(left, fit[near])
    return a, b


def _links(words: int, least: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links inside runs of equal buckets; rows (bucket, fp, text) come sorted by bucket."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        a, b = [], []
        bucket, fps = rows.column(0).to_numpy(), rows.column(1).to_numpy().view(U64)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
        for lo, hi in zip(cut, [*cut[1:], len(bucket)], strict=True):
            parts = [shingle_sets(x, words) for x in T.blocks(rows.column(2).slice(lo, hi - lo).combine_chunks())]
            h, size = np.concatenate([x for x, _ in parts]), np.concatenate([np.diff(f) for _, f in parts])
            first = np.concatenate([[0], np.cumsum(size)])
            # another text under the same id isn't the one that the band has
            own = np.flatnonzero(digests(h, first) == fps[lo:hi])
            own = own[np.unique(fps[lo:hi][own], return_index=True)[1]]
            held = np.repeat(np.isin(np.arange(hi - lo), own), size)
            own = np.sort(own)
            x, y = linked(h[held], np.concatenate([[0], np.cumsum(size[own])]), least)
            a.append(fps[lo:hi][own][x])
            b.append(fps[lo:hi][own][y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1], "left"))
            if held and (end or held[-1].column(0)[-1].as_py() != key[0]):
                yield of(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = []
            elif end:
                yield of(pa.Table.from_batches([batch.slice(0, end)]))
            held.append(batch.slice(end))
        if held:
            yield of(pa.Table.from_batches(held))

    return lambda batches: local_forest(runs(batches))


def first_of_each(docs: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, with one document of each group, the one with the smallest id.  Groups are joined by links,
    found by SimHash and by bands, of a Jaccard similarity of at least least[0] / least[1] between the sets of shingles of `words` words, lower-cased
    (A-Z); a shorter text has one shingle of them all, texts without words are alike.  Rows with a null id
    all stay and link nothing; equal rows of a document that stays all stay.  Columns may have any names.  An empty table gives an empty one."""
    tables = Tables(docs.sparkSession, "near_copies")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    marked = tables.written(rows.mapInArrow(T.released(_mark(words)), "doc_id long, fp long, keys array<long>"))
    kinds = tables.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("keys").alias("keys")))
    banded = kinds.select("fp", "least", F.posexplode("keys").alias("band", "key")).select("fp", "least", F.xxhash64("band", "key").alias("bucket"))
    # SimHash groups, by the text that stands for a kind; another text under its id only makes a bucket larger
    alike = grouped(tables.written(fingerprints(rows, words)), DISTANCE, tables).select("doc_id", "component_id").distinct()
    near = kinds.where(F.size("keys") > 0).join(alike, F.col("least") == F.col("doc_id")).select("fp", "least", F.xxhash64(F.lit(BANDS), "component_id").alias("bucket"))
    banded = banded.unionByName(near).distinct()
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    once = shared.groupBy("n", "x", "lo", "hi").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = tables.written(banded.join(once, "bucket"))
    texts = members.join(rows, F.col("least") == F.col("doc_id")).select("bucket", "fp", "text")
    links = texts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(T.released(_links(words, least)), "a long, b long")
    roots = tables.written(components(links, tables, shrunk=True))
    placed = kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = tables.written(placed.join(ids, "root").select("fp", "component_id"))
    gone = marked.select("doc_id", "fp").join(named, "fp").where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, F.col(id_col).cast("long"), gone)
