"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and word stems.  Beside the loss on labels it pays
for the change of its score when the identity terms of a labelled text are swapped for others of
their kind, so weight that a mere group mention would get moves to the words that go with either.  Labelled
texts without such terms get one put in, and pay for the change that makes and for that of the swap, so the
penalty holds for every term and stem, however rare it is among the labelled texts.

Features come by forward selection: the one that best explains what is left joins, and all
weights are fitted anew, so a rare word that only rides along with a copied toxic text is not taken
once the toxic word is.
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
from tessera.llm.langid import held_out

U64 = np.uint64

# Identity terms by kind; those of one kind stand in for each other.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy", "female", "male"),
    ("women", "men", "girls", "boys", "females", "males"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("mexican", "american", "chinese", "indian", "german", "french", "spanish"),
    ("old", "young", "elderly", "disabled"),
    ("femme", "homme", "fille", "garçon"),
    ("frau", "mann", "mädchen", "junge"),
    ("mujer", "hombre", "chica", "chico"),
)


@dataclass(frozen=True)
class Settings:
    """`rows`: at most so many labelled texts of either label, those with the smallest hashes of their ids, train the
    model; `least` texts must have a feature; `features` join at most, each
    with a `gain` over the root of its texts; `pull` weighs the counterfactual penalty."""

    rows: int = 2000
    stems: tuple[int, ...] = (4, 5)
    least: int = 3
    features: int = 120
    gain: float = 0.25
    ridge: float = 1e-4
    pull: float = 1.0


def _hash(word: str) -> int:
    low = T.Block(X.folded(np.frombuffer(word.encode(), dtype=np.uint8)), np.array([0, len(word.encode())]), 0, 1)
    return int(X.stem_hashes(low, low.offsets[:1], low.offsets[1:], ())[0][0])


def swaps() -> dict[int, str]:
    """Each identity term's hash and the next term of its kind."""
    return {_hash(w): kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, w in enumerate(kind)}


def features(block: T.Block, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes by word (words, 1 + stems), the words' documents, and the words' own hashes."""
    low, starts, ends, first = X.letter_words(block)
    by_word = np.stack(X.stem_hashes(low, starts, ends, stems), axis=1)
    return by_word, np.repeat(np.arange(len(block)), np.diff(first)), by_word[:, 0]


def _word_features(word: str, stems: tuple[int, ...]) -> np.ndarray:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return features(T.Block(raw, np.array([0, len(raw)]), 0, 1), stems)[0][0]


def _draw(batches: Iterator[pa.RecordBatch], stems: tuple[int, ...], among: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Distinct features of each text, and of the text with its identity terms swapped (null without any); of those `among`, if given."""

    def distinct(x: np.ndarray) -> np.ndarray:
        x = np.unique(x[x > 0])
        return (x if among is None else x[np.isin(x, among, assume_unique=True)]).view(np.int64)

    swapped = {h: _word_features(w, stems) for h, w in swaps().items()}
    terms = np.array(sorted(swapped), dtype=U64)
    for batch in batches:
        own, other = [], []
        for block in T.blocks(batch.column("text")):
            by_word, doc, words = features(block, stems)
            cut = np.searchsorted(doc, np.arange(len(block) + 1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                mine = by_word[a:b]
                own.append(distinct(mine))
                hit = np.flatnonzero(np.isin(words[a:b], terms))
                if len(hit):
                    turned = mine.copy()
                    turned[hit] = [swapped[int(h)] for h in words[a:b][hit]]
                    other.append(distinct(turned))
                else:
                    other.append(None)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, type=kind), pa.array(other, type=kind)], names=["doc_id", "toxic", "own", "other"])


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    settings: Settings


def _matrix(rows: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature that is among the columns."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=U64)
    at = np.searchsorted(columns, flat)
    held = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == flat) if len(columns) else np.zeros(len(flat), dtype=bool)
    return row[held], at[held]


def counterfactuals(own: list[np.ndarray], other: list[np.ndarray | None], columns: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, column and sign of what features each pair of texts differs in, and the number of pairs: a text and the same with its
    terms swapped; of a text without terms, with one put in and without, and with it and with the next of its kind."""
    rows, cols, signs = [], [], []
    n = 0

    def differ(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal n
        for sign, x, y in ((1.0, a, b), (-1.0, b, a)):
            more = np.setdiff1d(x, y)
            rows.append(np.full(len(more), n))
            cols.append(more)
            signs.append(np.full(len(more), sign))
        n += 1

    def among(x: np.ndarray) -> np.ndarray:
        return _matrix([np.unique(x[x > 0])], columns)[1]

    terms = [(among(_word_features(w, s.stems)), among(_word_features(kind[(i + 1) % len(kind)], s.stems))) for kind in IDENTITY_TERMS for i, w in enumerate(kind)]
    for i, (mine, turned) in enumerate(zip(own, other, strict=True)):
        if turned is not None:
            differ(among(mine), among(turned))
            continue
        term, swap = terms[i % len(terms)]
        if len(term) or len(swap):
            mine = among(mine)
            differ(np.union1d(mine, term), mine)
            differ(np.union1d(mine, term), np.union1d(mine, swap))
    none = np.zeros(0, dtype=np.int64)
    return *(np.concatenate([none, *x]).astype(k) for x, k in ((rows, np.int64), (cols, np.int64), (signs, float))), n


def train(own: list[np.ndarray], other: list[np.ndarray | None], label: np.ndarray, s: Settings) -> Model:
    """Forward selection with a fit of all weights after each feature, until none explains anything more."""
    none = np.zeros(0)
    if not len(label) or label.min() == label.max():
        bias = 0.0 if not len(label) else 6.0 * (2 * float(label[0]) - 1)
        return Model(np.zeros(0, dtype=U64), none, bias, s)
    pick = sorted({x.tobytes(): i for i, x in reversed(list(enumerate(own)))}.values())  # a text and its copies speak once
    own, other, y = [own[i] for i in pick], [other[i] for i in pick], label[pick].astype(float)
    every, count = np.unique(np.concatenate([x for x, t in zip(own, y, strict=True) if t] or [np.zeros(0, dtype=U64)]), return_counts=True)
    columns = every[count >= s.least]
    row, col = _matrix(own, columns)
    order = np.argsort(col, kind="stable")
    row, first = row[order], np.searchsorted(col[order], np.arange(len(columns)))
    size = np.diff(np.append(first, len(row)))
    pair_row, pair_col, pair_sign, pairs = counterfactuals(own, other, columns, s)
    weight = np.ones(len(y))
    chosen: list[int] = []
    dense, change = np.zeros((len(y), 0)), np.zeros((pairs, 0))
    w = X.newton(dense, y, weight, s.ridge)
    while len(columns) and len(chosen) < s.features:
        left = weight * (y - X.sigmoid(dense @ w[:-1] + w[-1]))
        gain = np.add.reduceat(left[row], first) / np.sqrt(size + 10.0)
        gain[chosen] = 0
        best = int(gain.argmax())
        if gain[best] < s.gain:
            break
        chosen.append(best)
        mine = np.zeros((len(y), 1))
        mine[row[first[best] : first[best] + size[best]]] = 1
        moved, here = np.zeros((pairs, 1)), pair_col == best
        np.add.at(moved[:, 0], pair_row[here], pair_sign[here])
        dense, change = np.concatenate([dense, mine], axis=1), np.concatenate([change, moved], axis=1)
        w = X.newton(dense, y, weight, s.ridge, change, s.pull)
    order = np.argsort(columns[chosen]) if chosen else np.zeros(0, dtype=int)
    return Model(columns[chosen][order] if chosen else np.zeros(0, dtype=U64), w[:-1][order], float(w[-1]), s)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled rows that aren't held out; see Settings for the bounds.  Labels other than 0 and 1, null
    ids and null texts are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out())
    there = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def drawn(label: int, among: np.ndarray | None) -> pa.Table:
        mine = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows)  # bounded by the setting
        found = texts.join(F.broadcast(mine.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id")
        found = found.mapInArrow(lambda batches: _draw(batches, settings.stems, among), "doc_id long, toxic int, own array<long>, other array<long>")
        return found.orderBy(F.xxhash64("doc_id"), "doc_id", "own").limit(settings.rows).toArrow()

    # whole feature lists of the toxic texts only: of the others what enough toxic ones have
    to = lambda x: np.asarray(x.values.to_numpy(zero_copy_only=False)).view(U64)
    toxic = drawn(1, None)
    every, count = np.unique(np.concatenate([to(x) for x in toxic.column("own")] or [np.zeros(0, dtype=U64)]), return_counts=True)
    clean = drawn(0, every[count >= settings.least])
    parts = [(to(own), to(other) if other.is_valid else None, t) for table, t in ((toxic, 1), (clean, 0)) for own, other in zip(table.column("own"), table.column("other"), strict=True)]
    model = train([x for x, _, _ in parts], [x for _, x, _ in parts], np.array([t for _, _, t in parts], dtype=np.int64), settings)
    # the sample may have one label more often than it comes: back to how often they come, so that 0.5 is the likelier one
    drawn_of = {t: min(there.get(t, 0), settings.rows) for t in (0, 1)}
    shift = sum((1 if t else -1) * np.log(there[t] / drawn_of[t]) for t in (0, 1)) if all(drawn_of.values()) else 0.0
    return Model(model.hashes, model.weights, model.bias + float(shift), settings)


def scores(model: Model, block: T.Block) -> np.ndarray:
    """Probability of the label for each document."""
    total = np.full(len(block), model.bias)
    if len(model.hashes):
        by_word, doc, _ = features(block, model.settings.stems)
        gate = np.zeros(1 << 16, dtype=bool)
        gate[(model.hashes >> U64(48)).astype(np.intp)] = True
        maybe = gate[(by_word >> U64(48)).astype(np.intp)]
        row, _ = np.nonzero(maybe)
        keys = by_word[maybe]
        at = np.minimum(np.searchsorted(model.hashes, keys), len(model.hashes) - 1)
        held = model.hashes[at] == keys
        once = np.unique(doc[row[held]] * len(model.hashes) + at[held])
        total += np.bincount(once // len(model.hashes), model.weights[once % len(model.hashes)], minlength=len(block))
    return X.sigmoid(total)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [scores(model, b) for b in T.blocks(batch.column("text"))]
        score = np.concatenate(parts) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id long, score double (0 to 1, higher: toxic likelier), predicted int (1 from 0.5).

    Null and empty texts have no features and score the bias; without labels of both kinds every text
    scores alike.  A feature counts once however often a text has it.  Null ids and repeated rows each
    get their row; only id and text are read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _predict(batches, model), "doc_id long, score double, predicted int")
