"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Votes form few patterns, so
all documents are counted by pattern, and expectation-maximisation on those counts estimates how
often each labeller is right on good and on bad documents, without any true label.  Its
posteriors label a bounded sample, on which a linear scorer over hashed words and word shapes is
trained; that scorer then judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _features as X
from tessera.llm import _text as T
from tessera.llm import quality_rules

U64 = np.uint64
BAD, NOTHING, GOOD = 0, 1, 2

_NEVER = (np.inf, -np.inf)

#: Labellers: a measure, under and over which values it votes bad, and from which to which good.
#: What is missing in most bad documents too says nothing, so most labellers only ever vote bad.
LABELLERS: tuple[tuple[str, float, float, float, float], ...] = (
    ("n_words", 20, np.inf, 50, np.inf), ("plain_words", 0.5, np.inf, 0.9, 1), ("different_words", 0.25, np.inf, 0.45, 1), ("symbols_a_word", -1, 0.2, *_NEVER), ("capitals", -1, 0.5, *_NEVER),
    ("repeated_windows", -1, 0.3, *_NEVER), ("repeated_lines", -1, 0.3, *_NEVER), ("same_as_last_word", -1, 0.2, *_NEVER), ("mark_runs", -1, 0.2, *_NEVER),
)
PATTERNS = 3 ** len(LABELLERS)

_UPPER, _LETTER, _MARK = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[list(b"!#$%&*+-./:;<=>?@\\^_`|~")] = True

#: What a plain word doesn't have before its last byte.
_ODD = np.ones(256, dtype=bool)
_ODD[65:91] = _ODD[97:123] = _ODD[128:] = _ODD[39] = _ODD[45] = False

#: Classes of bytes in a word's shape: small and capital letters, digits; other ASCII stands for itself, the rest is one class.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


@dataclass(frozen=True)
class Settings:
    """`rows`: at most so many texts, those with the smallest hashes of their ids, train the scorer; `bits` of a feature's hash."""

    rows: int = 3000
    bits: int = 15
    steps: int = 150
    rate: float = 0.5
    ridge: float = 1e-6


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), np.nan)


def votes(block: T.Block) -> np.ndarray:
    """Pattern of each document: its votes as digits to base 3, the first labeller's first."""
    data, offsets, n = block.data, block.offsets, len(block)
    found = quality_rules.measure(block)
    starts, ends, first = block.words()
    words = T.span_hashes(T.byte_prefix(data), starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    n_words = found["n_words"]
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    fresh = _distinct(words, doc, n)
    marks = np.zeros(len(data), dtype=bool)
    marks[1:] = _MARK[data[1:]] & (data[1:] == data[:-1])
    marks |= data == ord("|")
    ended = T.per_document(marks, offsets)
    odd = T.span_sums(_ODD[data], starts, np.maximum(ends - 1, starts)) == 0
    lines = np.maximum(T.per_document(data == 10, offsets) + 1, 1)
    measures = {
        "n_words": n_words.astype(float), "plain_words": _ratio(T.per_document(odd, first), n_words), "symbols_a_word": _ratio(found["n_symbols"], n_words), "capitals": _ratio(T.per_document(_UPPER[data], offsets), T.per_document(_LETTER[data], offsets)),
        "repeated_windows": _ratio(found["n_repeat_words"], n_words), "repeated_lines": np.where(n_words > 0, found["n_dup_lines"] / lines, np.nan), "same_as_last_word": _ratio(T.per_document(same, first), n_words),
        "different_words": np.where(n_words >= 20, _ratio(fresh, n_words), np.nan), "mark_runs": _ratio(ended, n_words),
    }
    pattern = np.zeros(n, dtype=np.int64)
    for name, under, over, low, high in LABELLERS:
        x = measures[name]
        with np.errstate(invalid="ignore"):
            vote = np.where((x < under) | (x > over), BAD, np.where((x >= low) & (x <= high), GOOD, NOTHING))
        pattern = pattern * 3 + vote
    return pattern


def _distinct(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Different words of each document."""
    keys = T.mix(words + (doc.astype(U64) + U64(1)) * U64(T.WORD_BASE))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(doc[first], minlength=n)


def digits(pattern: np.ndarray) -> np.ndarray:
    """Votes (patterns, labellers) of patterns."""
    return np.stack([pattern // 3**k % 3 for k in reversed(range(len(LABELLERS)))], axis=-1)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and how often each labeller votes what on (bad, good) documents."""

    good: float
    rates: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of good, by pattern."""
        vote = digits(pattern)
        log = np.log(self.rates)[np.arange(vote.shape[1]), :, vote].sum(axis=1)
        return X.sigmoid(log[:, 1] - log[:, 0] + np.log(self.good) - np.log1p(-self.good))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right where it votes."""
        share = np.array([1 - self.good, self.good])
        right = self.rates[:, 0, BAD] * share[0] + self.rates[:, 1, GOOD] * share[1]
        return right / (self.rates[:, :, [BAD, GOOD]].sum(axis=2) @ share)


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> LabelModel:
    """From the majority of votes to where the likelihood settles; counts are smoothed so that no rate is 0."""
    vote = digits(pattern)
    lead = (vote == GOOD).sum(axis=1) - 2.0 * (vote == BAD).sum(axis=1)
    p = X.sigmoid(lead)
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        share = np.stack([1 - p, p], axis=1) * count[:, None]
        rates = np.stack([[np.bincount(vote[:, j], share[:, y], minlength=3) + smooth for y in (0, 1)] for j in range(vote.shape[1])])
        good = float(np.clip((share[:, 1].sum() + smooth) / (count.sum() + 2 * smooth), 1e-6, 1 - 1e-6))
        model = LabelModel(good, rates / rates.sum(axis=2, keepdims=True))
        after = model.posterior(pattern)
        if np.abs(after - p).max(initial=0) < 1e-6:
            break
        p = after
    return model


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [votes(b) for b in T.blocks(batch.column(0))]
        seen, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def label_model(docs: DataFrame, text_col: str = "text") -> LabelModel:
    """Of all rows: each executor sends counts by pattern, of which there are PATTERNS at most."""
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counted.sort()
    return expectation_maximisation(np.array([r.pattern for r in counted], dtype=np.int64), np.array([r.n for r in counted], dtype=float))


def features(block: T.Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (words, 3) of the words, and each document's first word: the word, its shape with runs as one, and whether it repeats the last."""
    starts, ends, first = block.words()
    low = T.span_hashes(T.byte_prefix(T.LOWER[block.data]), starts, ends)
    shape = _SHAPE[block.data]
    kept = np.ones(len(shape), dtype=bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[starts] = True
    at = np.concatenate([[0], np.cumsum(kept)])
    shapes = T.mix(T.span_hashes(T.byte_prefix(shape[kept]), at[starts], at[ends]) ^ U64(1))
    again = np.zeros(len(low), dtype=U64)
    again[1:] = low[1:] == low[:-1]
    again[first[:-1][first[:-1] < len(low)]] = 0
    return (np.stack([low, shapes, T.mix(again + U64(2))], axis=1) >> U64(64 - bits)).astype(np.int64), first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means over each document's words; 0 without words."""
    return T.per_document(values, first) / np.maximum(np.diff(first), 1)


def _draw(batches: Iterator[pa.RecordBatch], model: LabelModel, bits: int) -> Iterator[pa.RecordBatch]:
    """Posterior label and feature shares of each text."""
    for batch in batches:
        labels, ids, shares = [], [], []
        for block in T.blocks(batch.column("text")):
            labels.append(model.posterior(votes(block)))
            found, first = features(block, bits)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                seen, n = np.unique(found[a:b], return_counts=True)
                ids.append(seen.astype(np.int32))
                shares.append((n / max(b - a, 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(labels) if labels else [], type=pa.float64()), pa.array(ids, type=pa.list_(pa.int32())), pa.array(shares, type=pa.list_(pa.float32()))], names=["doc_id", "label", "ids", "shares"]
        )


@dataclass(frozen=True)
class Model:
    labels: LabelModel
    weights: np.ndarray
    bias: float
    settings: Settings


def train(row: np.ndarray, ids: np.ndarray, shares: np.ndarray, label: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps scaled for each feature (Adagrad)."""
    w, b = np.zeros(1 << s.bits), 0.0
    past, past_b = np.full(len(w), 1e-8), 1e-8
    n = max(len(label), 1)
    for _ in range(s.steps):
        error = X.sigmoid(np.bincount(row, w[ids] * shares, minlength=len(label)) + b) - label
        g = np.bincount(ids, error[row] * shares, minlength=len(w)) / n + s.ridge * w
        past += g * g
        w -= s.rate * g / np.sqrt(past)
        past_b += error.mean() ** 2 if len(label) else 0.0
        b -= s.rate * (error.mean() if len(label) else 0.0) / np.sqrt(past_b)
    return w, float(b)


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The label model of all rows, and the scorer of a bounded sample of them; rows without an id aren't drawn."""
    labels = label_model(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows)  # bounded by the setting
    drawn = rows.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")
    found = drawn.mapInArrow(lambda batches: _draw(batches, labels, settings.bits), "doc_id long, label double, ids array<int>, shares array<float>")
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "ids").limit(settings.rows).toArrow()
    ids, shares = ([x.values.to_numpy(zero_copy_only=False) for x in table.column(c)] for c in ("ids", "shares"))
    none = np.zeros(0)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids]) if ids else np.zeros(0, dtype=np.int64)
    w, b = train(row, np.concatenate(ids) if ids else none.astype(np.int64), np.concatenate(shares) if ids else none, table.column("label").to_numpy(), settings)
    return Model(labels, w.astype(np.float32), b, settings)


def scores(model: Model, block: T.Block) -> np.ndarray:
    """Score of each document; 0 without words."""
    found, first = features(block, model.settings.bits)
    return (np.diff(first) > 0) * X.sigmoid(_sums(model.weights[found].sum(axis=1, dtype=np.float64), first) + model.bias)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [scores(model, block) for block in T.blocks(batch.column("text"))]
        score = np.concatenate(parts) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "score", "kept"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id long, score double (0 to 1, higher: better), kept boolean (score from 0.5).
    The labellers vote on every text once, for the label model; here the trained scorer alone speaks.

    Null and empty texts and texts without words score 0 and aren't kept.  Null ids and repeated rows
    each get their row; only id and text are read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _predict(batches, model), "doc_id long, score double, kept boolean")
