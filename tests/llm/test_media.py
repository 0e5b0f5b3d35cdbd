import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import media as M

SCHEMA = "doc_id long, text string, media string"


def brute_mulaw(u):
    u = ~u & 0xFF
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return -size if u & 128 else size


def brute_alaw(a):
    a ^= 0x55
    chord, size = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = (size + 256) << (chord - 1) if chord else size
    return size if a & 128 else -size


def brute_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for code in (c for b in block[4:] for c in (b & 15, b >> 4)):
        step = M.STEPS[index]
        diff = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
        value = max(-32768, min(32767, value + (-diff if code & 8 else diff)))
        index = max(0, min(88, index + M.INDEX_CHANGES[code & 7]))
        out.append(value)
    return out


def brute_resample(x, rate, to):
    out = []
    for i in range(len(x) * to // rate):
        a, part = divmod(i * rate, to)
        out.append((x[a] * (to - part) + x[min(a + 1, len(x) - 1)] * part) // to)
    return out


def test_tables():
    assert M.MULAW_TABLE.tolist() == [brute_mulaw(i) for i in range(256)] and M.ALAW_TABLE.tolist() == [brute_alaw(i) for i in range(256)]
    assert M.MULAW_TABLE[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0] and M.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def test_adpcm():
    raw = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert M.adpcm_blocks(raw).tolist() == [brute_adpcm(bytes(x)) for x in raw]


@pytest.mark.parametrize("to", [8000, 16000, 11025, 4000])
def test_resample(to):
    r = np.random.default_rng(2)
    clips = [r.integers(-32768, 32768, n).tolist() for n in (0, 1, 2, 7, 100)]
    offsets = np.cumsum([0, *map(len, clips)])
    out, at = M.resample(np.array(sum(clips, []), dtype=np.int16), offsets, 8000, to)
    assert [out[a:b].tolist() for a, b in zip(at, at[1:])] == [brute_resample(c, 8000, to) for c in clips]


TEXTS = [(0, "hello"), (1, ""), (2, None), (None, "x" * 64), (4, "ü" * 33), (5, "hello"), (6, "long " * 60_000), (6, "long " * 60_000)]


@pytest.mark.parametrize("tag", [M.MULAW, M.ALAW, M.IMA_ADPCM])
def test_round_trip(spark, tag):
    stored = M.store_text(spark.createDataFrame([(*t, "clash") for t in TEXTS], SCHEMA), tag)
    for row, (doc, text) in zip(stored.collect(), TEXTS, strict=True):
        raw = (text or "").encode()
        found, rate, at, n = M.parse_wav(bytes(row.media))
        assert (row.doc_id, row.n_bytes, found, rate) == (doc, len(raw), tag, 8000)
        assert n % 64 == 0 and n > 0 and bytes(row.media)[at : at + n] == raw + bytes(n - len(raw)) and n - len(raw) <= 64
    pcm = M.to_pcm(stored, 8000).collect()
    row, out = next(x for x in stored.collect() if x.doc_id == 0), next(x for x in pcm if x.doc_id == 0)
    body = bytes(row.media)[M.parse_wav(bytes(row.media))[2] :][:64]
    want = brute_adpcm(body) if tag == M.IMA_ADPCM else [(brute_mulaw if tag == M.MULAW else brute_alaw)(b) for b in body]
    found, rate, at, n = M.parse_wav(bytes(out.pcm))
    assert (found, rate) == (M.PCM, 8000) and np.frombuffer(bytes(out.pcm)[at : at + n], "<i2").tolist() == want


def test_not_audio(spark):
    rows = [(1, None), (2, b""), (3, b"RIFFxxxxWAVE"), (4, M.wav(b"", M.MULAW)), (5, M.wav(b"\1\2", 85))]
    got = {r.doc_id: r.pcm for r in M.to_pcm(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert [got[i] for i in (1, 2, 3, 5)] == [None] * 4 and M.parse_wav(bytes(got[4]))[3] == 0


def brute_feature(media, to_rate=16000):
    """Samples one by one, as the header says."""
    tag, rate, at, n = M.parse_wav(media)
    body = media[at : at + n]
    if tag == M.IMA_ADPCM:
        line = [x for i in range(0, n - 63, 64) for x in brute_adpcm(body[i : i + 64])]
    else:
        line = [(brute_mulaw if tag == M.MULAW else brute_alaw)(b) for b in body]
    line = brute_resample(line, rate, to_rate)
    turns = sum((a < 0) != (b < 0) for a, b in zip(line, line[1:]))
    raw = np.array(line, "<i2").tobytes()
    return f"{len(line)}:{max(map(abs, line), default=0)}:{sum(map(abs, line))}:{turns}:{zlib.crc32(raw):08x}", M.wav(raw, M.PCM, to_rate)


def test_describe(spark):
    texts = TEXTS + [(10 + i, f"text number {i} " * (i + 1)) for i in range(12)]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], SCHEMA)
    got = M.describe(M.store_text(docs)).collect()
    assert len(got) == len(texts) and got[0].feature == got[5].feature != got[1].feature == got[2].feature
    tags = set()
    for row, (_, text) in zip(got, texts, strict=True):
        raw = (text or "").encode()
        raw += bytes(max(-(-len(raw) // 64), 1) * 64 - len(raw))
        assert (row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        tag = (M.MULAW, M.ALAW, M.IMA_ADPCM)[zlib.crc32(raw) % 3]
        tags.add(tag)
        wav = M.wav(raw, tag)
        assert (row.media_bytes, row.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        line, pcm = brute_feature(wav)
        assert row.feature.split("=")[1] == line and (row.pcm_bytes, row.pcm_sha256) == (len(pcm), hashlib.sha256(pcm).hexdigest())
    assert len(tags) == 3


def test_files_are_read_as_their_headers_say(spark):
    data = bytes(range(256)) + b"odd"
    files = [M.wav(data, tag) for tag in (M.MULAW, M.ALAW, M.IMA_ADPCM)] + [M.wav(data, M.MULAW, 11025), M.wav(b"", M.ALAW)]
    rows = [(i, 0, f) for i, f in enumerate(files)] + [(7, 0, None), (8, 0, b"no audio"), (9, 0, M.wav(data, 85)), (None, None, files[0]), (0, 0, files[0])]
    got = M.describe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    for row, (_, _, media) in zip(got, rows, strict=True):
        if media is None or M.parse_wav(media)[0] not in (M.MULAW, M.ALAW, M.IMA_ADPCM):
            assert row.feature is None and row.payload_bytes is None and row.pcm_bytes is None and row.media_bytes == (None if media is None else len(media))
            continue
        assert row.feature.split("=")[1] == brute_feature(media)[0] and row.payload_bytes == M.parse_wav(media)[3]


def test_empty(spark):
    assert M.describe(M.store_text(spark.createDataFrame([], SCHEMA))).count() == 0
