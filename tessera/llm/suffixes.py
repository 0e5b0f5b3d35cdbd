"""Passages that stand twice, by sparse suffix arrays.

A text is a sequence of words.  Of its suffixes only those are retained that start at minimisers:
the `seed`-word grams with the smallest hash of `window` = `words` - `seed` + 1 neighbouring ones.  The
content alone selects them, so every passage of `words` words has one at the same place wherever
the passage stands.

Most suffixes have no partner, and a first pass over hashes of their first `seed` words drops them.  How far a
match of `words` words may reach around a suffix is its context, `window` - 1 words to the left and `words` to the
right.  Suffixes with equal contexts match all through, whatever their number: they are kept as one representative, the
first of them, and its members.  The representatives that still have different partners are sorted: by the hash of their
first `seed` words, then word by word, then by the words to the left.  Ranges of that order, sampled by Spark, are the slices of the
suffix array.  They are cut between seeds, but for a seed with more representatives than a slice should hold: that is cut by the
words to the right and the left, so no passage, however common, has to stand in one slice.

In a slice the common prefixes of neighbours (in words) say which suffixes share how much to the right.  Each is
then extended to the left: those that share `words` - a words from here on and the a words before match in a window of
`words` words, for every such window of which the suffix is the minimiser.  What of a cut seed touches an end of its slice may go on in the
next one; such windows are settled by an aggregate over the slices.  The result is exact: all windows of `words`
words that stand twice, and the first place of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._tables import Tables

U64 = np.uint64
_TOP = U64(0xFFFFFFFFFFFFFFFF)
#: Suffixes of one slice of the suffix array, about.
SLICE_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    """`words`: the shortest passage; `seed`: words that retained suffixes must share to meet."""

    words: int = 50
    seed: int = 25

    @property
    def window(self) -> int:
        return self.words - self.seed + 1


def _sliding(x: np.ndarray, width: int, pick: np.ufunc, fill: int | np.uint64) -> np.ndarray:
    """Least or greatest of x[i : i + width] for every i, what is past the end being `fill`."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        ahead = np.full_like(out, fill)
        ahead[:-step] = out[step:]
        out = pick(out, ahead)
        done += step
    return out


def retained(words: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of retained suffixes in the joined word hashes, their seeds' hashes, their documents, and how many words
    before them, at least and at most, begin the windows of which they are the minimiser.

    In each window of seeds inside a document the smallest hash is retained, at all its places there."""
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    whole = at + s.seed <= end
    seeds = np.full(n, _TOP, dtype=U64)
    start = at[whole]
    seeds[start] = T.gram_hashes(T.word_prefix(words), start, start + s.seed)
    least = _sliding(seeds, s.window, np.minimum, _TOP)
    least[at + s.words > end] = U64(0)  # no window of `words` words starts here
    # a seed is retained if it is the least of some window that has it: the greatest of the windows' leasts
    behind = np.zeros(n, dtype=U64)
    if n:
        behind = _sliding(least[::-1], s.window, np.maximum, U64(0))[::-1]
    held = np.flatnonzero(whole & (seeds == behind))
    held = held[seeds[held] != 0]
    low, high = np.full(len(held), s.window), np.full(len(held), -1)
    for a in range(s.window):  # these windows are neighbours
        mine = (held - a >= first[doc[held]]) & (least[np.maximum(held - a, 0)] == seeds[held])
        low[mine] = np.minimum(low[mine], a)
        high[mine] = a
    kept = high >= 0
    held = held[kept]
    return held, seeds[held], doc[held], low[kept], high[kept]


def _context_ends(place: np.ndarray, doc: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(place - (s.window - 1), first[doc]), np.minimum(place + s.words, first[doc + 1])


def _word_hashes(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = block.words()
    return T.span_hashes(T.byte_prefix(block.data), starts, ends), first


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, digest) of rows with an id; rows of one id are told apart by their texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.withColumn("digest", F.xxhash64("text"))


def _suffixes(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in T.blocks(batch.column(1)):
            words, first = _word_hashes(block)
            place, seed, doc, least, most = retained(words, first, s)
            low, high = _context_ends(place, doc, first, s)
            # the words around and where among them the seed is: this alone tells the seed as well
            context = T.mix(T.gram_hashes(T.word_prefix(words), low, high) ^ T.mix((place - low).astype(U64)))
            at = pa.array(doc + block.lo)
            columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array((place - first[doc]).astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(seed.view(np.int64)), pa.array(context.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "place", "after", "before", "seed", "context"])


def suffixes(docs: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, place, after, before, seed, context) of every retained suffix, the minimiser of the windows that begin `after` to `before` words before it; rows without an id share nothing and are left out."""
    return _rows(docs, id_col, text_col).mapInArrow(T.released(lambda batches: _suffixes(batches, s)), "doc_id long, digest long, place int, after int, before int, seed long, context long")


def _padded(words: np.ndarray, start: np.ndarray, step: int, count: np.ndarray, width: int) -> pa.Array:
    """Word hashes from each start on, `count` of them, zeros up to `width`, as binary that sorts word by word."""
    k = np.arange(width)
    at = start[:, None] + step * k
    held = k < count[:, None]
    grid = np.where(held, words[np.where(held, at, 0)] if len(words) else U64(0), U64(0)).astype(">u8")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), len(start), [None, pa.py_buffer(grid.tobytes())]).cast(pa.binary())


def _contexts(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The words to the right and, nearest first, to the left of each wanted place."""
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            words, first = _word_hashes(block)
            wanted = batch.column("places").slice(block.lo, len(block))
            doc = np.repeat(np.arange(len(block)), wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = wanted.flatten()
            own = flat.field("place").to_numpy().astype(np.int64)
            place = own + first[doc]
            low, high = _context_ends(place, doc, first, s)
            at = pa.array(doc + block.lo)
            columns = [flat.field("seed"), flat.field("context"), batch.column("doc_id").take(at), batch.column("digest").take(at), *(flat.field(c) for c in ("place", "after", "before", "shared", "large"))]
            columns += [_padded(words, place, 1, high - place, s.words), _padded(words, place - 1, -1, place - low, s.window - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "context", "doc_id", "digest", "place", "after", "before", "shared", "large", "right", "left"])


_MATCHED = "context long, from int, to int, doc_id long, digest long, place int, shared boolean, key long"


def _grid(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(U64).reshape(-1, width)


def _chain(grid: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... words of each row."""
    out = np.zeros((grid.shape[1] + 1, len(grid)), dtype=U64)
    for k in range(grid.shape[1]):
        out[k + 1] = T.mix(out[k] * U64(T.WORD_BASE) + grid[:, k])
    return out


def neighbours(right: np.ndarray) -> np.ndarray:
    """Words that each sorted suffix shares with the one before it; 0 for the first."""
    out = np.zeros(len(right), dtype=np.int64)
    differ = right[1:] != right[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
    return out


def _slice(rows: pa.Table, s: Settings) -> pa.RecordBatch:
    """Matches of one slice of the suffix array.  Rows with `key` are windows that may go on in the next slices: those say
    where they stand themselves, the others the first place of what they match."""
    context = rows.column("context").to_numpy()
    new = np.ones(len(context), dtype=bool)
    new[1:] = context[1:] != context[:-1]  # a repeated row has its suffixes twice
    rows, context = rows.filter(pa.array(new)), context[new]
    number = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    right, left = _grid(rows.column("right"), s.words), _grid(rows.column("left"), s.window - 1)
    doc, digest, place, shared, large, after, before = (number(c) for c in ("doc_id", "digest", "place", "shared", "large", "after", "before"))
    order = np.lexsort((place, digest, doc))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    common, to_right, to_left = neighbours(right), _chain(right), _chain(left)
    from_first, to_last = (np.where((d := right != right[i]).any(axis=1), d.argmax(axis=1), s.words) for i in (0, -1))
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    open_: list[tuple[np.ndarray, int, np.ndarray]] = []
    for a in range(s.window):
        need = s.words - a
        group = np.cumsum(common < need)
        own = np.flatnonzero((after <= a) & (a <= before))
        if not len(own):
            continue
        edge = large[own] & ((from_first[own] >= need) | (to_last[own] >= need))
        if edge.any():
            at = own[edge]
            open_.append((at, a, T.mix(to_right[need][at] ^ T.mix(to_left[a][at] + U64(a)))))
        own = own[~edge]
        if not len(own):
            continue
        # suffixes with the same words to the right, extended to the left by a words, and neighbours among these
        by = np.lexsort((rank[own], to_left[a][own], group[own]))
        own = own[by]
        fresh = np.ones(len(own), dtype=bool)
        fresh[1:] = (group[own][1:] != group[own][:-1]) | (to_left[a][own][1:] != to_left[a][own][:-1])
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(own)))
        several = (size > 1) | shared[own[start]]
        held = np.repeat(several, size)
        found.append((own[held], a, np.repeat(own[start], size)[held]))
    none = np.zeros(0, dtype=np.int64)
    row = np.concatenate([x for x, _, _ in found] or [none])
    low = np.concatenate([x for _, _, x in found] or [none])
    a = np.concatenate([np.full(len(x), k) for x, k, _ in found] or [none])
    by = np.lexsort((a, low, row))
    row, low, a = row[by], low[by], a[by]
    cut = np.ones(len(row), dtype=bool)
    cut[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1]) | (a[1:] != a[:-1] + 1)
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(row))[: len(start)] - 1
    row_o = np.concatenate([x for x, _, _ in open_] or [none])
    a_o = np.concatenate([np.full(len(x), k) for x, k, _ in open_] or [none])
    key = np.concatenate([x for _, _, x in open_] or [none.astype(U64)])
    where = np.concatenate([low[start], row_o])
    columns = [
        pa.array(np.concatenate([context[row[start]], context[row_o]])), pa.array(np.concatenate([-a[end], -a_o]).astype(np.int32)), pa.array(np.concatenate([-a[start], -a_o]).astype(np.int32)), pa.array(doc[where]), pa.array(digest[where]), pa.array(place[where].astype(np.int32)),
        pa.array(shared[where]), pa.array(np.concatenate([np.zeros(len(start), dtype=np.int64), key.view(np.int64)]), mask=np.concatenate([np.ones(len(start), dtype=bool), np.zeros(len(key), dtype=bool)])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MATCHED.split(", ")])


def _slices(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield _slice(pa.Table.from_batches(held), s)


def shared_windows(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, digest long, first int, last int, least long, own boolean, same boolean), a written table: every
    window of `words` words of doc_id's text of that digest (xxhash64) whose first word is from `first` to `last` stands at
    another place too, in another text or in this one.  The first place, by id, digest and word, is in a text of the id `least`; `same`
    where that is this text, `own` where it is this very place.

    Words are `[^\\x20\\x09-\\x0D]+`, compared by 64-bit hashes.  A row is its id and its text: rows of one id with different texts are
    different texts, repeated rows share nothing with each other.  Rows with a null id and texts of fewer words, null and empty ones included, share nothing.
    Other columns are not read.  An empty table gives an empty result.
    """
    s, tables = settings, Tables(docs.sparkSession, "suffixes")
    found, found_path = tables.write(suffixes(docs, s, id_col, text_col))
    here = F.xxhash64("doc_id", "digest", "place")
    # most seeds stand at one place only, and go first
    seeds = tables.written(found.groupBy("seed").agg(F.min(here).alias("low"), F.max(here).alias("high")).where("low < high").select("seed"))
    # joined as a table, not as an aggregate: a hot seed's suffixes can then be split
    met, met_path = tables.write(found.join(seeds, "seed"))
    tables.drop(found_path)
    groups = tables.written(met.groupBy("seed", "context").agg(F.min(F.struct("doc_id", "digest", "place")).alias("one"), (F.min(here) < F.max(here)).alias("shared"), F.min("after").alias("after"), F.min("before").alias("before")))
    several = tables.written(groups.groupBy("seed").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select("seed", (F.col("contexts") > SLICE_ROWS).alias("large")))
    mixed = groups.join(several, "seed")
    wanted = mixed.groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.digest").alias("digest")).agg(F.collect_list(F.struct(F.col("one.place").alias("place"), "after", "before", "seed", "context", "shared", "large")).alias("places"))
    lookup = _rows(docs, id_col, text_col).join(wanted, ["doc_id", "digest"]).select("doc_id", "digest", "text", "places")
    ends = tables.written(lookup.mapInArrow(T.released(lambda batches: _contexts(batches, s)), "seed long, context long, doc_id long, digest long, place int, after int, before int, shared boolean, large boolean, right binary, left binary"))
    cut = ["seed", *[F.when(F.col("large"), F.col(c)) for c in ("right", "left")]]
    matched = tables.written(ends.repartitionByRange(ends.count() // SLICE_ROWS + 1, *cut).sortWithinPartitions("seed", "right", "left", "context").mapInArrow(T.released(lambda batches: _slices(batches, s)), _MATCHED))
    low = ["low_doc", "low_digest", "low_place"]
    across = matched.where("key is not null")
    keys = tables.written(across.groupBy("key").agg(F.min(F.struct("doc_id", "digest", "place")).alias("low"), F.count(F.lit(1)).alias("n"), F.max("shared").alias("shared")).where("n > 1 or shared"))
    settled = across.join(keys.select("key", F.col("low.doc_id").alias(low[0]), F.col("low.digest").alias(low[1]), F.col("low.place").alias(low[2])), "key").select("context", F.col("from").alias("offset"), *low).distinct()
    # neighbouring windows with one first place become one run
    rank = F.row_number().over(W.partitionBy("context", *low).orderBy("offset"))
    runs = settled.withColumn("run", F.col("offset") - rank).groupBy("context", *low, "run").agg(F.min("offset").alias("from"), F.max("offset").alias("to"))
    inside = matched.where("key is null").select("context", "from", "to", *[F.col(c).alias(x) for c, x in zip(("doc_id", "digest", "place"), low, strict=True)])
    # the windows of a context that is its seed's only one are shared alike
    alone = groups.where("shared").join(several, "seed", "left_anti").select("context", F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to"), *[F.col(f"one.{c}").alias(x) for c, x in zip(("doc_id", "digest", "place"), low, strict=True)])
    matches = tables.written(runs.select("context", "from", "to", *low).unionByName(inside).unionByName(alone))
    same = (F.col("low_doc") == F.col("doc_id")) & (F.col("low_digest") == F.col("digest"))
    spans = met.join(matches, "context").select(
        "doc_id", "digest", (F.col("place") + F.coalesce("from", -F.col("before"))).alias("first"), (F.col("place") + F.coalesce("to", -F.col("after"))).alias("last"), F.col("low_doc").alias("least"), (same & (F.col("low_place") == F.col("place"))).alias("own"), same.alias("same")
    )
    out = tables.written(spans)
    tables.drop(met_path)
    return out


def _islands(spans: DataFrame, words: int, *by: str) -> DataFrame:
    """(doc_id, digest, *by, first_word, end_word, least, own): maximal runs of words that the windows of each text cover."""
    keys = ["doc_id", "digest", *by]
    by_doc = W.partitionBy(*keys).orderBy("first", "last")
    before = F.max(F.col("last") + words).over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    numbered = spans.withColumn("fresh", (before.isNull() | (F.col("first") > before)).cast("int"))
    numbered = numbered.withColumn("island", F.sum("fresh").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("first").cast("long").alias("first_word"), (F.max("last") + words).cast("long").alias("end_word"), F.min("least").alias("least"), F.bool_and("own").alias("own")).drop("island")


def repeated_passages(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage, a maximal run of words in windows that stand elsewhere too: doc_id, first_word, n_words,
    first_doc_id (the smallest id that has some of these windows), n_passages of the text (long), is_first (all its windows have
    their first place here).  Texts that share and repeat nothing have no row; see shared_windows() for nulls and repeated rows."""
    found = _islands(shared_windows(docs, settings, id_col, text_col), settings.words)
    return found.select(
        "doc_id", "first_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), F.col("least").alias("first_doc_id"), F.count(F.lit(1)).over(W.partitionBy("doc_id", "digest")).alias("n_passages"), F.col("own").alias("is_first")
    )


#: What becomes of a run of words: it goes, it goes but for what stays, it stays.
ELSEWHERE, AGAIN, FIRST = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words that go and the white space after them."""
    for batch in batches:
        texts = []
        for block in T.blocks(batch.column("text")):
            starts, _, first = block.words()
            runs = batch.column("runs").slice(block.lo, len(block))
            raw = block.data.tobytes()
            for i, mine in enumerate(runs):
                a, b = int(block.offsets[i]), int(block.offsets[i + 1])
                if not mine.is_valid:
                    texts.append(batch.column("text")[block.lo + i].as_py())
                    continue
                at = np.append(starts[first[i] : first[i + 1]], b)
                where = np.zeros((3, len(at)), dtype=bool)
                for run in mine.as_py():
                    where[run["kind"], run["first_word"] : run["end_word"]] = True
                gone = where[ELSEWHERE] | where[AGAIN] & ~where[FIRST]
                gone[-1] = False
                turn = np.flatnonzero(gone[:-1] != gone[1:]) + 1
                edges = [0, *turn.tolist()] if gone[0] else turn.tolist()
                kept, done = [], a
                for low, high in zip(edges[::2], edges[1::2], strict=True):
                    kept.append(raw[done : at[low]])
                    done = int(at[high])
                texts.append(b"".join([*kept, raw[done:b]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, type=pa.string()), batch.column("touched")], names=["row", "text", "touched"])


def without_repeats(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """Rows of `docs`, all columns, without the words in windows that have their first place in another text; the first text, by id and
    then digest, keeps a passage.  Of a passage that a text itself repeats the first place stays, and what of a later one overlaps it.
    A text that loses all its words goes; texts that lose nothing stay as they are, null, empty and repeated ones and those without an id included.
    `chars_col`, where there is such a column, is the length of the text that stays.  Columns may have any names.  An empty table gives an empty one."""
    spans = shared_windows(docs, settings, id_col, text_col)
    kind = F.when(F.col("own"), FIRST).when(F.col("same"), AGAIN).otherwise(ELSEWHERE)
    runs = _islands(spans.withColumn("kind", kind), settings.words, "kind").groupBy("doc_id", "digest").agg(F.min("kind").alias("least_kind"), F.collect_list(F.struct("kind", "first_word", "end_word")).alias("runs")).where(F.col("least_kind") < FIRST)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"))
    joined = rows.join(runs, ["doc_id", "digest"], "left").select("row", "text", F.col("runs").isNotNull().alias("touched"), "runs")
    cut = joined.mapInArrow(_cut, joined.select("row", "text", "touched").schema).where(~F.col("touched") | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    old = lambda c: F.col(f"row.{quoted(c)}")
    return cut.select(*[
        F.when(F.col("touched"), F.col("text")).otherwise(old(c)).alias(c) if c == text_col else F.when(F.col("touched"), F.length("text")).otherwise(old(c)).cast(docs.schema[c].dataType).alias(c) if c == chars_col else old(c).alias(c) for c in docs.columns
    ])
