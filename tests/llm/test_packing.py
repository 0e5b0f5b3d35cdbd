import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _text as T
from tessera.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string"


def brute_best_fit(lengths, limit):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(limit - n)
    return room


@pytest.mark.parametrize("seed", range(40))
def test_best_fit(seed):
    r = random.Random(seed)
    limit = r.choice([5, 16, 64, 1024])
    top = r.choice([limit, max(2, limit // 2), max(2, limit // 5)])
    lengths = [r.randint(1, top) for _ in range(r.choice([1, 30, 400]))] + [r.randint(1, limit)] * r.choice([0, 77])
    runs, bins = packing.best_fit(Counter(lengths), limit)
    want = brute_best_fit(lengths, limit)
    assert bins == len(want)
    spans, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in runs:
        for k in range(n):
            spans[first + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
    room = []
    for b in range(bins):
        end = 0
        for offset, length in sorted(spans[b]):
            assert offset == end
            end += length
        assert 0 < end <= limit
        room.append(limit - end)
    assert sorted(room) == sorted(want)


def test_tree():
    tree = packing.CapacityTree(20)
    assert tree.tightest(1) is None
    for c in (3, 9, 20):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    tree.set(9, False)
    assert tree.tightest(4) == 20


ODD = [
    "", " ", "  two  spaces  ", "a\n b\t c \n\n d", "it's we'll  don't 's", "x y   z   w　 v", "<|endoftext|> <|endoftext|>", "über straße 東京 は 🙂 🙂x", "a\x85 b \x1c c", " lead", "trail ", "    x ​ y", "1 2 33 4,5 %% !! --", "É é è «a» »b",
]


def expected_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_tokens(most):
    r = random.Random(4)
    texts = ODD + ["".join(r.choices([*ODD, " ", " ", "\n", "ab", "'", " ", "7"], k=r.randint(1, 40))) for _ in range(200)]
    tokens, of = packing.Tokens(PATH), expected_ids()
    got = []
    for block in T.blocks(pa.array(texts), most):
        ids, starts = tokens.of(block)
        got += [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
    assert got == [of(t) for t in texts]


def test_encoders_agree():
    r = random.Random(6)
    (fast, _), of = packing.encoder(PATH), expected_ids()
    for _ in range(2000):
        text = " " + "".join(r.choices(["ing", "th", "ü", "Ü", "東", "z", "q", "\x85", "'", "1", "!", "a", "e", "\u0301", "🙂"], k=r.randint(1, 25)))
        assert fast(text) == of(text)


def test_pack(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices(["the", "of", "Straße", "x1", "\n"], k=r.choice([3, 40, 400, 900, 3000]))) for _ in range(60)]
    rows = [(i, t, "c") for i, t in enumerate([*texts, *ODD, None])] + [(None, "null id", "c"), (7, "twice", "c"), (7, "twice", "c")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, 256).collect()
    of = expected_ids()
    docs, want, sizes = defaultdict(list), [], []
    for doc, text, _ in rows:
        ids = [*of(text or ""), 2]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            sizes.append(b - a)
    key = lambda x: tuple(map(str, x))
    assert sorted([(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got], key=key) == sorted(want, key=key)
    for x in got:
        docs[x.sequence_id].append((x.offset, x.length))
    for spans in docs.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
    assert len(docs) == len(brute_best_fit(sizes, 256))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_other_tokenisers_get_whole_texts(spark, tmp_path):
    """One whose words hold spaces can't be cut at them."""
    from tokenizers import Tokenizer, models

    vocabulary = {c: i + 10 for i, c in enumerate("abc xyzé")} | {"a b": 50, "b c": 51, "[UNK]": 0}
    path = str(tmp_path / "own.json")
    Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", continuing_subword_prefix="", max_input_chars_per_word=10**6)).save(path)
    encode, cut = packing.encoder(path)
    assert not cut and encode("a b c") == [50, 13, 12]
    texts = ["a b c", "x y a b", "", None, "b c b c", "a b " * 500]
    got = packing.pack(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA), path, limit=4096).collect()
    whole = Tokenizer.from_file(path)
    for row in got:
        ids = [*whole.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def test_very_long_text(spark):
    text = " ".join(f"word{i % 977}" for i in range(150_000))
    got = packing.pack(spark.createDataFrame([(1, text, ""), (2, "x", ""), (1, text, "")], SCHEMA), PATH).collect()
    ids = packing.encoder(PATH)[0](text)
    mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 1)
    raw = np.array([*ids, 2], dtype="<u4")
    assert sum(x[2] for x in mine) == 2 * len(raw) and all(zlib.crc32(raw[a : a + n].tobytes()) == c for _, a, n, c in mine)
    seen = defaultdict(list)
    for r in got:
        seen[r.sequence_id].append((r.offset, r.length))
    for spans in seen.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
