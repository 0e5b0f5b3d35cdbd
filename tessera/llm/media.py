"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM in WAV containers, and PCM from them.

Samples are expanded by lookup tables (G.711) or decoded block by block, every step over all
blocks of a batch at once (ADPCM: only the samples of one block depend on each other), then
resampled by linear interpolation in whole numbers and stored as 16-bit PCM.  A file's own header says how
it is read.  A file is held whole, with its samples: a worker needs some 30 times the longest one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T

# Fixed values of the WAV format: format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
FORMATS = (MULAW, ALAW, IMA_ADPCM)
_NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA_ADPCM: "adpcm"}

RATE = 8000
#: Payloads are padded with zeros to a multiple of this, which is also the size of an ADPCM block.
UNIT = 64

# Fixed values of IMA ADPCM: quantiser steps, and changes of the step index by a code's magnitude.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
INDEX_CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    chord, step = a >> 4 & 7, (a & 0x0F) << 4
    size = np.where(chord == 0, step + 8, step + 0x108 << np.maximum(chord - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor, and the next index times 16, at index * 16 + code."""
    steps, code = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (steps >> 3) + np.where(code & 4, steps, 0) + np.where(code & 2, steps >> 1, 0) + np.where(code & 1, steps >> 2, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + np.array(INDEX_CHANGES)[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
_CHANGE, _NEXT = _adpcm_tables()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * (size - 4)) int16 of n mono IMA blocks (n, size) uint8: first sample and
    step index in the first four bytes (an index over the largest counts as that), then codes, low half first."""
    n, size = blocks.shape
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), n), dtype=np.int16)
    out[0] = blocks[:, 0].astype(np.uint16) | blocks[:, 1].astype(np.uint16) << 8
    value = out[0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    for i, pair in enumerate(body):
        for k, code in enumerate((pair & 15, pair >> 4)):
            index += code
            value += _CHANGE[index]
            np.clip(value, -32768, 32767, out=value)
            index = _NEXT[index]
            out[1 + 2 * i + k] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, offsets: np.ndarray, rate: int, to_rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Clips of a batch at another rate, by linear interpolation rounded down; the last sample is held."""
    if rate == to_rate:
        return pcm, offsets
    n = np.diff(offsets) * to_rate // rate
    to = np.concatenate([[0], np.cumsum(n)])
    at = (np.arange(to[-1]) - np.repeat(to[:-1], n)) * rate
    base = np.repeat(offsets[:-1], n)
    low, part = at // to_rate, at % to_rate
    high = np.minimum(low + 1, np.repeat(np.diff(offsets) - 1, n))
    mixed = pcm[base + low].astype(np.int64) * (to_rate - part) + pcm[base + high] * part
    return (mixed // to_rate).astype(np.int16), to


def wav(data: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAV file of stored samples; its sizes are 32-bit numbers, so data has less than 4 GB."""
    width, block, extra, count = {PCM: (16, 2, b"", len(data) // 2), IMA_ADPCM: (4, UNIT, struct.pack("<H", 2 * UNIT - 7), len(data) // UNIT * (2 * UNIT - 7))}.get(tag, (8, 1, b"", len(data)))
    speed = rate * block if tag != IMA_ADPCM else rate * UNIT // (2 * UNIT - 7)
    form = struct.pack("<HHIIHHH", tag, 1, rate, speed, block, width, len(extra)) + extra
    odd = b"\0" * (len(data) % 2)
    chunks = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + struct.pack("<4sII", b"fact", 4, count) + struct.pack("<4sI", b"data", len(data)) + data + odd
    return struct.pack("<4sI", b"RIFF", len(chunks)) + chunks


def parse_wav(media: bytes) -> tuple[int, int, int, int]:
    """(format tag, rate, first data byte, data bytes) of a WAV file; (0, 0, 0, 0) of anything else."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return 0, 0, 0, 0
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and n >= 16 and at + 24 <= len(media):
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data":
            return tag, rate, at + 8, min(n, len(media) - at - 8)
        at += 8 + n + n % 2
    return 0, 0, 0, 0


def pad(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of a block: its texts' bytes and zeros up to a positive multiple of UNIT."""
    n = np.diff(block.offsets)
    to = np.concatenate([[0], np.cumsum(np.maximum(-(-n // UNIT), 1) * UNIT)])
    out = np.zeros(to[-1], dtype=np.uint8)
    out[np.arange(len(block.data)) + np.repeat(to[:-1] - block.offsets[:-1], n)] = block.data
    return out, to


def chosen(payload: bytes) -> int:
    """One of the three formats, by the payload's crc32, so equal payloads are stored alike."""
    return FORMATS[zlib.crc32(payload) % len(FORMATS)]


def _store(batches: Iterator[pa.RecordBatch], tag: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in T.blocks(batch.column(1)):
            data, to = pad(block)
            raw = data.tobytes()
            parts = [raw[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            media = [wav(x, chosen(x) if tag is None else tag) for x in parts]
            ids = batch.column(0).slice(block.lo, block.hi - block.lo)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(block.offsets)), pa.array(media, type=pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_text(docs: DataFrame, tag: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, n_bytes long, media binary): each text's UTF-8 bytes, padded with zeros to a positive
    multiple of 64, as the stored samples of a WAV file with the given format tag, or one of three by its content (mu-law, A-law and
    ADPCM, whose units are bytes, bytes and 64-byte blocks).  Null texts are empty ones; null ids and
    repeated rows stay; other columns are not read.  An empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _store(batches, tag), "doc_id long, n_bytes long, media binary")


def decode(data: np.ndarray, offsets: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples of stored clips of one format, and where each clip starts."""
    if tag in (MULAW, ALAW):
        return (MULAW_TABLE if tag == MULAW else ALAW_TABLE)[data], offsets
    if tag == IMA_ADPCM:
        if (offsets % UNIT).any():
            raise ValueError("ADPCM clips must be whole blocks")
        samples = adpcm_blocks(data.reshape(-1, UNIT))
        return samples.ravel(), offsets // UNIT * samples.shape[1]
    if tag == PCM:
        return data.view("<i2").astype(np.int16), offsets // 2
    raise ValueError(f"no decoder for format {tag}")


def _media_blocks(column: pa.Array) -> Iterator[tuple[T.Block, list[bytes], list[tuple[int, int, int, int]]]]:
    """Blocks of a media column with its files and what their headers say."""
    for block in T.blocks(column):
        raw = block.data.tobytes()
        files = [raw[a:b] for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
        yield block, files, [parse_wav(x) for x in files]


def _samples(files: list[bytes], heads: list[tuple[int, int, int, int]], tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Stored bytes of files, joined; for ADPCM whole blocks only."""
    cut = [f[at : at + (n - n % UNIT if tag == IMA_ADPCM else n - n % 2 if tag == PCM else n)] for f, (_, _, at, n) in zip(files, heads, strict=True)]
    return np.frombuffer(b"".join(cut), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in cut], dtype=np.int64)]).astype(np.int64)


def _pcm_files(files: list[bytes], heads: list[tuple[int, int, int, int]], to_rate: int) -> list[bytes | None]:
    """Each file's samples, decoded as its header says and resampled, as a 16-bit PCM file; None for what has no decoder."""
    out: list[bytes | None] = [None] * len(files)
    for tag, rate in sorted({h[:2] for h in heads if h[0] in _NAMES and h[1]}):
        own = [i for i, h in enumerate(heads) if h[:2] == (tag, rate)]
        data, offsets = _samples([files[i] for i in own], [heads[i] for i in own], tag)
        pcm, to = resample(*decode(data, offsets, tag), rate, to_rate)
        for i, a, b in zip(own, to[:-1].tolist(), to[1:].tolist(), strict=True):
            out[i] = wav(pcm[a:b].astype("<i2").tobytes(), PCM, to_rate)
    return out


def _to_pcm(batches: Iterator[pa.RecordBatch], to_rate: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, files, heads in _media_blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, len(files)), pa.array(_pcm_files(files, heads, to_rate), type=pa.binary())], names=["doc_id", "pcm"])


def to_pcm(media: DataFrame, to_rate: int = 16000, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id long, pcm binary): each stored file decoded, resampled and stored as 16-bit PCM WAV.
    What is null, no WAV file, or of another format gives null; a clip without samples stays empty."""
    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(lambda batches: _to_pcm(batches, to_rate), "doc_id long, pcm binary")


def _features(pcm: np.ndarray, offsets: np.ndarray) -> list[str]:
    """samples:peak:sum of sizes:sign changes:crc32 of each clip."""
    size = np.abs(pcm.astype(np.int32))
    sums = T.per_document(size, offsets)
    turns = np.zeros(len(pcm), dtype=bool)
    turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turns[offsets[:-1][offsets[:-1] < len(pcm)]] = False
    changes = T.per_document(turns, offsets)
    peaks = [int(size[a:b].max(initial=0)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    raw = memoryview(pcm.astype("<i2").tobytes())
    crcs = [zlib.crc32(raw[2 * a : 2 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [f"{n}:{p}:{s}:{c}:{x:08x}" for n, p, s, c, x in zip(np.diff(offsets).tolist(), peaks, sums.tolist(), changes.tolist(), crcs, strict=True)]


_DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm_bytes long, pcm_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch], to_rate: int) -> Iterator[pa.RecordBatch]:
    sha = lambda x: None if x is None else hashlib.sha256(x).hexdigest()
    size = lambda x: None if x is None else len(x)
    for batch in batches:
        for block, files, heads in _media_blocks(batch.column(2)):
            there = batch.column(2).slice(block.lo, len(files)).is_valid().to_pylist()
            media = [f if x else None for f, x in zip(files, there, strict=True)]
            stored = [f[at : at + n] if tag in _NAMES else None for f, (tag, _, at, n) in zip(files, heads, strict=True)]
            pcm = _pcm_files(files, heads, to_rate)
            # the stored PCM is read back as any file is
            own = [i for i, x in enumerate(pcm) if x is not None]
            samples, offsets = _samples([pcm[i] for i in own], [parse_wav(pcm[i]) for i in own], PCM)
            feature: list[str | None] = [None] * len(files)
            for i, line in zip(own, _features(*decode(samples, offsets, PCM)), strict=True):
                feature[i] = f"{_NAMES[heads[i][0]]}@{heads[i][1]}>pcm@{to_rate}={line}"
            columns = [
                batch.column(0).slice(block.lo, len(files)), batch.column(1).slice(block.lo, len(files)), pa.array([size(x) for x in stored], type=pa.int64()), pa.array([sha(x) for x in stored], type=pa.string()), pa.array([None if x is None else zlib.crc32(x[-UNIT:]) for x in stored], type=pa.int64()),
                pa.array([size(x) for x in media], type=pa.int64()), pa.array([sha(x) for x in media], type=pa.string()), pa.array([size(x) for x in pcm], type=pa.int64()), pa.array([sha(x) for x in pcm], type=pa.string()), pa.array(feature, type=pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DESCRIBED.split(", ")])


def describe(media: DataFrame, to_rate: int = 16000) -> DataFrame:
    """What store_text() has stored, (doc_id, n_bytes, media), read back as the files' headers say: payload size, sha256 and crc32 of its
    last 64 bytes, size and sha256 of the whole file, size and sha256 of the 16-bit PCM file that its samples become, decoded and resampled,
    and features of the samples read back from that: their number, peak, sum of sizes, sign changes and crc32.

    A null file has only nulls; of what is no WAV file of a known format only size and sha256 are known.  A file without samples has empty
    ones; of an ADPCM file whose data isn't whole blocks the whole blocks are decoded, the payload is all of it.  Null
    ids and repeated rows each get their row; other columns are not read.  An empty table gives an empty result."""
    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media")
    return rows.mapInArrow(lambda batches: _describe(batches, to_rate), _DESCRIBED)
