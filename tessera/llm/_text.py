"""Vectorised text kernels over the raw UTF-8 buffers of Arrow string columns.

Nothing here loops over documents or words in Python: a batch is one byte array with
document offsets, words are start and end positions in it, and hashes of any span come
from prefix sums.  Batches are cut into blocks of bounded bytes so that a worker's memory
does not follow the size of Arrow's batches; a document is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Bytes of text worked on at once.
BLOCK_BYTES = 1 << 19

# Odd multipliers of the span hashes, and the finaliser's constants (splitmix64).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes that belong to letters: ASCII letters and every byte of a multi-byte character.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(30))
    h *= U64(MIX_1)
    h ^= h >> U64(27)
    h *= U64(MIX_2)
    h ^= h >> U64(31)
    return h


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a longer block comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, dtype=U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))
        return self.up, self.down


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def _prefix(codes: np.ndarray, powers: _Powers) -> np.ndarray:
    up, _ = powers.get(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * up[: len(codes)], dtype=U64, out=out[1:])
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes() takes the hash of any byte span."""
    return _prefix(_BYTE_CODES[data], _BYTES)


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    _, down = _BYTES.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def word_prefix(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which gram_hashes() takes the hash of any run of words."""
    return _prefix(hashes, _WORDS)


def gram_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of words, from the first to before the end."""
    _, down = _WORDS.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


class Block:
    """Some whole documents: their bytes, and where each starts and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.data, self.offsets, self.lo, self.hi = data, offsets, lo, hi

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and each document's first word (one more at the end)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(len(self.offsets), dtype=np.int64)
        inside = table[self.data]
        fresh = np.empty(n, dtype=bool)
        fresh[0], fresh[1:] = True, ~inside[:-1]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        fresh[cuts] = True
        last = np.empty(n, dtype=bool)
        last[-1], last[:-1] = True, ~inside[1:]
        last[cuts - 1] = True
        starts, ends = np.flatnonzero(inside & fresh), np.flatnonzero(inside & last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null is an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def joined(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and its offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _buffers(column)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Runs of whole documents of at most `most` bytes, or one longer document."""
    data, offsets = _buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi)
        lo = hi


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by document, where document i has values first[i] to first[i + 1]."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of whole values over spans."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` as a task that gives back what its allocators hold when it ends: workers wait for their next task while others need the memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return task
