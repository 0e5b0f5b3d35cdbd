"""Best-fit decreasing packing of tokenised documents into sequences, exact at any size.

Best-fit decreasing looks at lengths only, and there are no more different lengths than tokens
in a sequence.  So executors tokenise and count documents by length, the driver packs that
histogram, and the plan that comes back places every document.  The packer handles a run of
equal documents and a run of equally full bins in one step, found by a segment tree over
remaining capacities; its result is that of taking documents one by one.  Histogram and plan are
bounded by the sequence length, not by the corpus.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._tables import Tables

#: Salts that split the documents of one length for ranking.
SALTS = 1024
#: Tokenised chunks that a worker remembers, and their ids; beyond either it starts anew.
MOST_CHUNKS, MOST_IDS = 300_000, 3_000_000
#: Bytes of text encoded at once; the more, the fewer chunks are looked up again.
TOKEN_BLOCK_BYTES = 2 << 20


class CapacityTree:
    """Segment tree over capacities 0..limit, each leaf true while some open bin has that much room."""

    def __init__(self, limit: int):
        self.size = 1 << (limit + 1).bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, value: bool) -> None:
        i = self.size + capacity
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that some open bin has."""
        i = self.size + need
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(counts: dict[int, int], limit: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, documents, first bin, offset) and the number of bins, for counts[length]
    documents of each length from 1 to `limit`: ranks of a run go to consecutive bins, each at `offset`.
    Longest first, each to an open bin with the least room that is enough, else to a new one."""
    tree, room = CapacityTree(limit), [[] for _ in range(limit + 1)]
    runs, bins = [], 0

    def open_up(capacity: int, first: int, n: int) -> None:
        if capacity:
            if not room[capacity]:
                tree.set(capacity, True)
            room[capacity].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = limit
                first, free = bins, -(-left // (limit // length))
                bins += free
            else:
                first, free = room[capacity].pop(0)
                if not room[capacity]:
                    tree.set(capacity, False)
            # a bin that has taken one and has room for the next is the tightest, so it takes as many as fit
            each = capacity // length
            full = min(free, left // each)
            rest = left - full * each if full < free else 0
            for at, n, per in ((first, full, each), (first + full, 1, rest)):
                if n and per:
                    for k in range(per):
                        runs.append((length, rank, n, at, limit - capacity + k * length))
                        rank += n
                    left -= n * per
                    open_up(capacity - per * length, at, n)
            used = full + bool(rest)
            if used < free:
                open_up(capacity, first + used, free - used)
    return runs, bins


#: Fixed value: what the byte-level pre-tokeniser cuts texts into.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others by the characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> tuple[Callable[[str], list[int]], bool]:
    """Encodes texts with the vocabulary of a `tokenizers` file, and whether texts may be cut at spaces before.  Where that is a plain byte-level
    BPE whose ids stand in the order of its merges, they serve as the ranks of a quicker encoder of the same ids, and they may."""
    with open(path) as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    plain = model["type"] == "BPE" and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
    if plain and ids == sorted(ids) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        import tiktoken

        byte, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, True
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return (lambda text: slow.encode(text, add_special_tokens=False).ids), False


class Tokens:
    """Ids of texts.  The byte-level pre-tokeniser never joins a space that stands before a
    non-space to what is before it, so texts are cut there, and equal chunks are encoded once.  For any other
    tokeniser a text is one chunk."""

    def __init__(self, path: str):
        self.encode, self.cut = encoder(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.used = np.zeros(1 << 16, dtype=np.uint32), np.zeros((1 << 14) + 1, dtype=np.int64), 0

    def learn(self, chunks: list[str]) -> None:
        at = len(self.known)
        new = list(map(self.encode, chunks))
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        flat = np.fromiter(itertools.chain.from_iterable(new), dtype=np.uint32, count=int(sizes.sum()))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < at + len(new) + 1:
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), dtype=np.int64)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[at + 1 : at + len(new) + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.known.update(zip(chunks, range(at, at + len(new)), strict=True))

    def of(self, block: T.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's documents, joined, and where each document's start."""
        if len(self.known) > MOST_CHUNKS or self.used > MOST_IDS:
            self.clear()
        data, offsets, n = block.data, block.offsets, len(block.data)
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        cut = np.zeros(n + 1, dtype=bool)
        after = data[1:]
        # not before other space, nor before what may begin a space outside ASCII
        if self.cut:
            cut[: n - 1] = (data[:-1] == 0x20) & (after > 0x20) & (after != 0xC2) & ((after < 0xE1) | (after > 0xE3))
        cut[offsets] = True
        at = np.flatnonzero(cut)
        chunks = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pc.dictionary_encode(chunks)
        words = coded.dictionary.to_pylist()
        of_word = np.fromiter((self.known.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        if len(missing := np.flatnonzero(of_word < 0)):
            of_word[missing] = np.arange(len(missing)) + len(self.known)
            self.learn([words[i] for i in missing.tolist()])
        first = self.starts[of_word]
        sizes = (self.starts[of_word + 1] - first)[index := coded.indices.to_numpy()]
        ends = np.zeros(len(index) + 1, dtype=np.int64)
        np.cumsum(sizes, out=ends[1:])
        where = np.repeat(first[index] - ends[:-1], sizes)
        where += np.arange(len(where))
        return self.ids[where], ends[np.searchsorted(at, offsets)]


def _pieces(path: str, limit: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            for block in T.blocks(batch.column(1), TOKEN_BLOCK_BYTES):
                ids, starts = tokens.of(block)
                doc, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    raw = np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes()
                    n = b - a + 1
                    cuts = [0, *range(n % limit or limit, n + 1, limit)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        doc.append(i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(raw[4 * x : 4 * y]))
                own = batch.column(0).slice(block.lo, block.hi - block.lo).take(pa.array(doc, type=pa.int64()))
                row = pa.array(np.array(doc, dtype=np.int32) + block.lo)
                columns = [own, row, pa.array(piece, type=pa.int32()), *(pa.array(x, type=pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): each text's ids and the end id, cut so that all pieces
    but the first have `limit` ids.  `tokenizer` is the path of a byte-level BPE file that every executor can read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, limit, end_id), "doc_id long, row int, piece int, start long, length long, ids_crc32 long")


def placed(cut: DataFrame, limit: int) -> DataFrame:
    """Pieces (a written table) with sequence_id and offset."""
    spark: SparkSession = cut.sparkSession
    # a whole sequence has nothing to be fitted to: any number of its own will do
    whole = cut.where(F.col("length") == limit).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    order = ["doc_id", "piece", "start", "ids_crc32", "row"]
    salted = cut.where(F.col("length") < limit).withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select("length", "salt", "n", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in salted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer than `limit` rows
    runs, _ = best_fit(histogram, limit)
    # a few rows for each pair of lengths at most, whatever the corpus
    plan = spark.createDataFrame([(a, b, b + n, c, o) for a, b, n, c, o in runs], "length long, rank_from long, rank_to long, bin long, bin_offset long")
    # each salt's ranks are neighbours and so lie in few runs: these go along with the salt, in order
    mine = shares.join(plan, "length").where("rank_to > before and rank_from < before + n")
    lookup = mine.groupBy("length", "salt", "before").agg(F.sort_array(F.collect_list(F.struct("rank_from", "rank_to", "bin", "bin_offset"))).alias("runs"))
    ranked = salted.withColumn("at", F.row_number().over(W.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(lookup, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at"))
    found = ranked.withColumn("run", F.get(F.filter("runs", lambda x: (x["rank_from"] <= F.col("rank")) & (F.col("rank") < x["rank_to"])), F.lit(0)))
    fitted = found.withColumn("sequence_id", F.col("run.bin") + F.col("rank") - F.col("run.rank_from")).withColumn("offset", F.col("run.bin_offset"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(*columns).unionByName(fitted.select(*columns))


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id long, piece int, start, length, ids_crc32, sequence_id, offset (long).

    A document is the ids of its text (special tokens' strings are ordinary text) and `end_id`; null and
    empty texts have the end id alone.  Only documents of over `limit` ids are cut, into pieces of
    `limit` of which the first may be shorter.  Sequences hold at most `limit` ids without gaps.
    ids_crc32 is that of the piece's ids as little-endian unsigned 32-bit numbers.  Null ids and repeated rows are
    packed each for itself; columns besides id and text are not read.  An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "packing")
    return placed(tables.written(pieces(docs, tokenizer, limit, end_id, id_col, text_col)), limit)
