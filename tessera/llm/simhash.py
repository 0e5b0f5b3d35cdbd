"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has bit i set if over half of its shingles' hashes have it set.  Two
fingerprints that differ in at most `distance` = 3 of 64 bits differ in at most one bit of one
of their two 32-bit segments, so that segment is equal once the right bit is left out.  Every
distinct fingerprint is therefore indexed under each segment with each bit in turn left out;
an equality grouping of these one-wildcard variants brings each linked pair together, and
counting the bits of the whole fingerprints verifies it.  Equal fingerprints collapse before
that, and a bucket yields a spanning forest of its links, not its pairs.

Segments: distance // 2 + 1 of them, so one of them differs by at most one bit.  A bucket of over `MOST_BUCKET`
fingerprints, as templated texts may fill it, is not searched in its task but dealt out anew: its fingerprints
are indexed a second time by the variants of the segments of the bits outside the first one, of which one differs by at
most one bit again.  Members of such a smaller bucket agree in all but some 18 bits, which bounds it.

The hash of each shingle is a call of its own, the dearest part of this operator; the rest is array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._tables import Tables, without
from tessera.llm.components import Forest, components

U64 = np.uint64
BITS = 64
SEED = 42
#: Distinct fingerprints of a bucket that are searched in one task; more are dealt out by a second index.
MOST_BUCKET = 8192


def _shingles(block: T.Block, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The block lower-cased with words joined by single spaces, its shingles' byte starts and ends, and their count by document."""
    starts, ends, first = block.words()
    low = T.LOWER[block.data]
    held = T.SPACED[block.data]
    low[~held] = 0x20
    inner = np.ones(len(ends), dtype=bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    held[ends[inner]] = True
    at = np.cumsum(held, dtype=np.int64)
    new_starts = at[starts] - 1
    new_ends = new_starts + (ends - starts)
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    base = np.concatenate([[0], np.cumsum(n)])
    which = np.arange(base[-1]) - np.repeat(base[:-1] - first[:-1], n)
    last = np.minimum(which + words - 1, np.repeat(first[1:] - 1, n))
    return low[held].tobytes(), new_starts[which], new_ends[last], n


def fingerprints_of(block: T.Block, words: int) -> np.ndarray:
    """Fingerprint of each document of a block; 0 without words."""
    text, starts, ends, n = _shingles(block, words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=U64, count=len(starts))
    out = np.zeros(len(n), dtype=U64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0, dtype=np.int32)
        majority = 2 * sums > n[some][:, None]
        out[some] = np.packbits(majority, axis=1, bitorder="little").copy().view(U64)[:, 0]
    return out


def _fingerprint(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints_of(b, words) for b in T.blocks(batch.column(1))]
            found = np.concatenate(parts) if parts else np.zeros(0, dtype=U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) for every row; the 64 bits of fp are the fingerprint."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint(words), "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; one of them differs in one bit at most."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masks(distance: int) -> list[int]:
    """The bits of each variant: a segment without one of its bits."""
    return [((1 << width) - 1 << low) & ~(1 << low + i) for low, width in segments(distance) for i in range(width)]


def _second_masks(distance: int, mask: int) -> list[int]:
    """The bits of each variant of the bits outside the segment that `mask` is of."""
    low, width = next((a, w) for a, w in segments(distance) if mask >> a & (1 << w) - 1)
    others = [i for i in range(BITS) if not low <= i < low + width]
    n = distance // 2 + 1
    parts = [others[len(others) * i // n : len(others) * (i + 1) // n] for i in range(n)]
    return [sum(1 << j for j in part if j != i) for part in parts for i in part]


def _keys(fp: np.ndarray, masks: list[int]) -> np.ndarray:
    """(masks, fingerprints): hashes of the masked bits and of which mask it was."""
    place = np.arange(1, len(masks) + 1, dtype=U64)[:, None] * U64(T.BYTE_BASE)
    return T.mix(fp[None, :] & np.array(masks, dtype=U64)[:, None] ^ place)


def _variants(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each fingerprint under every segment with each of its bits left out."""
    masks = _masks(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U64)
            for lo in range(0, len(fp), 4096):
                part = fp[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(_keys(part, masks).ravel().view(np.int64)), pa.array(np.tile(part.view(np.int64), len(masks)))], names=["key", "fp"])

    return run


def _second_variants(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, fp) of large buckets under the variants of the bits outside the segment that the key is of."""
    masks = _masks(distance)
    second = [_second_masks(distance, m) for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = (batch.column(i).to_numpy().view(U64) for i in (0, 1))
            for lo in range(0, len(fp), 4096):
                k, part = key[lo : lo + 4096], fp[lo : lo + 4096]
                which = (_keys(part, masks) == k).argmax(axis=0)
                for m in np.unique(which).tolist():
                    mine = which == m
                    keys = T.mix(_keys(part[mine], second[m]) + k[mine])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(part[mine].view(np.int64), len(second[m])))], names=["key", "fp"])

    return run


def linked(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: a search from each in turn over
    those not yet reached, so a dense group costs little more than its size."""
    left, a, b = fps, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                new = left[near]
                a.append(np.full(len(new), x))
                b.append(new)
                queue.extend(new)
                left = left[~near]
    none = np.zeros(0, dtype=U64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(distance: int, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A spanning forest of the links inside runs of equal keys; rows come sorted by key.  Runs of over `most` rows come back as they
    are, (key, fp) with `late`, as they are read: nothing holds them."""

    def of(forest: Forest, key: np.ndarray, fp: np.ndarray) -> None:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.concatenate([cut, [len(key)]]))
        a, b = [], []
        two = cut[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance if len(two) else np.zeros(0, dtype=bool)
        a.append(fp[two][near])
        b.append(fp[two + 1][near] if len(two) else fp[:0])
        for lo, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = linked(fp[lo : lo + n], distance)
            a.append(x)
            b.append(y)
        pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1).view(np.int64), axis=0)
        forest.add(pair[:, 0], pair[:, 1])

    def rows(a: np.ndarray, b: np.ndarray, late: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), late))], names=["a", "b", "late"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, large = Forest(), None
        key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(U64)])
            while len(key):
                end = int(np.searchsorted(key, key[0], "right"))
                if large == key[0] or most is not None and end > most:
                    large = int(key[0])
                    yield rows(key[:end], fp[:end], True)
                    key, fp = key[end:], fp[end:]
                    continue
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(start)  # of all runs but the last, which may go on
                over = np.flatnonzero(size > most) if most is not None else size[:0]
                end = int(start[over[0]]) if len(over) else int(start[-1])
                if not end:
                    break
                of(forest, key[:end], fp[:end])
                key, fp = key[end:], fp[end:]
                if not len(over):
                    break
        of(forest, key, fp)
        yield rows(*forest.edges(), False)

    return run


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id long, fingerprint (16 lowercase hex digits), component_id
    long (smallest doc_id reachable over links of at most `distance` bits, itself included).

    Texts are lower-cased (A-Z) and cut into words `[^\\x20\\x09-\\x0D]+`; a text of fewer words
    than a shingle has one shingle of them all, and a text without words, empty or null, has
    fingerprint zero, which links like any other.  Rows with a null id are kept, take part in
    links, and give no component its id (a component of such rows only has a null one).  Rows
    repeated with one id each get a row.  Columns besides id and text are not read, so their
    names can't clash.  An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "simhash")
    marked = tables.written(fingerprints(docs, words, id_col, text_col))
    return grouped(marked, distance, tables)


def grouped(marked: DataFrame, distance: int, tables: Tables) -> DataFrame:
    """near_duplicates() of a written (doc_id, fp) table."""
    kinds = tables.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    index = kinds.select("fp").mapInArrow(_variants(distance), "key long, fp long")
    schema = "a long, b long, late boolean"
    found = tables.written(index.repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance, MOST_BUCKET), schema))
    large = found.where("late").select("a", "b").mapInArrow(_second_variants(distance), "key long, fp long")
    more = large.repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance, None), schema)
    links = found.where(~F.col("late")).unionByName(more).select("a", "b")
    roots = tables.written(components(links, tables, shrunk=True))
    placed = kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = tables.written(placed.join(ids, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, words: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` with one document of each near-duplicate group, the one with the smallest id;
    equal rows of that document all stay, rows with a null id all stay.  All columns are kept, whatever their names.  An
    empty table gives an empty one."""
    groups = near_duplicates(docs, words, distance, id_col, text_col)
    return without(docs, F.col(id_col).cast("long"), groups.where("doc_id <> component_id").select("doc_id").distinct())
