"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units, one from either end, read a text, and every byte gets a probability for
each language from both states; the probabilities of a document's letters are averaged.  Texts are read in
windows of `span` bytes that overlap: each begins `around` bytes before its own and ends as many after, so
that a state has seen what stands next to it on both sides.  Windows of many documents run side by
side, so each time step is a few array operations, and a long text is no longer than others.

Training is backpropagation through time in numpy, truncated to pieces of `piece` bytes, over all pieces of the
whole texts of a bounded number of labelled documents of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as T

UNKNOWN = "und"
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Settings:
    """Sizes of the network, and the bound of training: at most `documents` labelled documents of each language, drawn by
    hashes of their ids, with their whole texts; `steps` batches at least, and as many as the language with
    most pieces needs to have each drawn once."""

    span: int = 256
    around: int = 32
    piece: int = 64
    embed: int = 8
    hidden: int = 12
    documents: int = 250
    steps: int = 300
    batch: int = 128
    rate: float = 0.01
    seed: int = 7
    #: Windows run side by side when predicting.
    lanes: int = 1024


def start_weights(classes: int, s: Settings) -> Weights:
    r = np.random.default_rng(s.seed)
    normal = lambda *shape, size: (r.standard_normal(shape) * size).astype(np.float32)
    bias = np.zeros((2, 3 * s.hidden), dtype=np.float32)
    bias[:, : s.hidden] = 1.0  # keep the state at first
    return {
        "embed": normal(256, s.embed, size=0.5), "w": normal(2, s.embed, 3 * s.hidden, size=s.embed**-0.5), "u": normal(2, s.hidden, 3 * s.hidden, size=s.hidden**-0.5),
        "bias": bias, "out": normal(2, s.hidden, classes, size=s.hidden**-0.5), "out_bias": np.zeros(classes, dtype=np.float32),
    }


def both_ways(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """Bytes (span, 2, segments) of segments read forwards and backwards; what is past an end is its last byte."""
    step = np.arange(span)[:, None]
    forward = data[starts + np.minimum(step, sizes - 1)]
    return np.stack([forward, data[starts + np.maximum(sizes - 1 - step, 0)]], axis=1)


def _tables(p: Weights) -> tuple[np.ndarray, np.ndarray]:
    """What each byte adds to the gates and to the candidate, both ways in one table of 512 rows."""
    h = p["u"].shape[1]
    table = (p["embed"][None] @ p["w"] + p["bias"][:, None]).reshape(512, 3 * h)
    return np.ascontiguousarray(table[:, : 2 * h]), np.ascontiguousarray(table[:, 2 * h :])


def position_probabilities(p: Weights, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(span, segments, classes): probabilities of the languages at every byte."""
    span, _, n = x.shape
    h = p["u"].shape[1]
    gate_of, new_of = _tables(p)
    gate_of = gate_of * np.float32(0.5)  # a gate is (1 + tanh(half its sum)) / 2
    rows = x.astype(np.intp)
    rows[:, 1] += 256
    u_gate, u_new = p["u"][:, :, : 2 * h] * np.float32(0.5), np.ascontiguousarray(p["u"][:, :, 2 * h :])
    state = np.zeros((2, n, h), dtype=np.float32)
    logits = np.empty((span, 2, n, p["out"].shape[2]), dtype=np.float32)
    gate, new = np.empty((2, n, 2 * h), dtype=np.float32), np.empty((2, n, h), dtype=np.float32)
    own_gate, own_new = np.empty_like(gate), np.empty_like(new)
    for t in range(span):
        np.take(gate_of, rows[t], axis=0, out=gate, mode="clip")
        gate += np.matmul(state, u_gate, out=own_gate)
        np.tanh(gate, out=gate)
        gate += 1
        gate *= 0.5
        np.take(new_of, rows[t], axis=0, out=new, mode="clip")
        np.matmul(state, u_new, out=own_new)
        own_new *= gate[:, :, h:]
        new += own_new
        np.tanh(new, out=new)
        state -= new
        state *= gate[:, :, :h]
        state += new
        np.matmul(state, p["out"], out=logits[t])
    return _softmax(_joined(logits, sizes, p["out_bias"]))


def _mirror(span: int, sizes: np.ndarray) -> np.ndarray:
    """The step at which the backward reader is at each byte; bytes past the end stand for themselves."""
    step = np.arange(span)[:, None]
    return np.where(step < sizes, sizes - 1 - step, step)


def _joined(logits: np.ndarray, sizes: np.ndarray, bias: np.ndarray) -> np.ndarray:
    span, _, n, classes = logits.shape
    back = np.take(logits[:, 1].reshape(-1, classes), _mirror(span, sizes) * n + np.arange(n), axis=0)
    back += logits[:, 0]
    back += bias
    return back


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(np.moveaxis(x, -1, 0))  # few classes: first, so that inner loops are long
    x = np.exp(x - x.max(axis=0))
    x /= x.sum(axis=0)
    return np.moveaxis(x, 0, -1)


def loss_and_gradients(p: Weights, x: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over all bytes of the segments, and its gradients by backpropagation through time."""
    span, _, n = x.shape
    h, kind = p["u"].shape[1], p["u"].dtype
    table = (p["embed"][None] @ p["w"] + p["bias"][:, None]).reshape(512, 3 * h)
    rows = x.astype(np.intp)
    rows[:, 1] += 256
    states = np.zeros((span + 1, 2, n, h), dtype=kind)
    zs, rs, news, inner = (np.empty((span, 2, n, h), dtype=kind) for _ in range(4))
    for t in range(span):
        a, s = table[rows[t]], states[t]
        b = s @ p["u"]
        z, r = 1 / (1 + np.exp(-a[..., :h] - b[..., :h])), 1 / (1 + np.exp(-a[..., h : 2 * h] - b[..., h : 2 * h]))
        new = np.tanh(a[..., 2 * h :] + r * b[..., 2 * h :])
        states[t + 1] = new + z * (s - new)
        zs[t], rs[t], news[t], inner[t] = z, r, new, b[..., 2 * h :]
    probability = _softmax(_joined(states[1:] @ p["out"], sizes, p["out_bias"]))
    held = (np.arange(span)[:, None] < sizes).astype(kind)
    total = held.sum()
    at = np.take_along_axis(probability, np.broadcast_to(label[None, :, None], (span, n, 1)), axis=2)[..., 0]
    loss = float(-(np.log(at + 1e-12) * held).sum() / total)
    d = probability.copy()
    d[:, np.arange(n), label] -= 1
    d *= held[..., None] / total
    d_logits = np.stack([d, np.take_along_axis(d, _mirror(span, sizes)[:, :, None], axis=0)], axis=1)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out_bias"] = d.sum(axis=(0, 1))
    g["out"] = np.einsum("tdnh,tdnc->dhc", states[1:], d_logits)
    d_table = np.empty((span, 2, n, 3 * h), dtype=kind)
    back, u_t = np.zeros((2, n, h), dtype=kind), p["u"].transpose(0, 2, 1)
    d_states = d_logits @ p["out"].transpose(0, 2, 1)
    for t in reversed(range(span)):
        ds, z, r, new = d_states[t] + back, zs[t], rs[t], news[t]
        d_new = ds * (1 - z) * (1 - new * new)
        d_z = ds * (states[t] - new) * z * (1 - z)
        d_r = d_new * inner[t] * r * (1 - r)
        d_table[t] = np.concatenate([d_z, d_r, d_new], axis=2)
        d_u = np.concatenate([d_z, d_r, d_new * r], axis=2)
        g["u"] += states[t].transpose(0, 2, 1) @ d_u
        back = ds * z + d_u @ u_t
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    seen, first = np.unique(flat[order], return_index=True)
    by_byte = np.zeros((512, 3 * h), dtype=kind)
    by_byte[seen] = np.add.reduceat(d_table.reshape(-1, 3 * h)[order], first, axis=0)
    by_byte = by_byte.reshape(2, 256, 3 * h)
    g["bias"] = by_byte.sum(axis=1)
    g["w"] = p["embed"].T[None] @ by_byte
    g["embed"] = (by_byte @ p["w"].transpose(0, 2, 1)).sum(axis=0)
    return loss, g


def train(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, label: np.ndarray, classes: int, s: Settings) -> Weights:
    """Adam on batches of pieces; every language is drawn alike often, each of its pieces once before any again."""
    r = np.random.default_rng(s.seed)
    p = start_weights(classes, s)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by_class = [np.flatnonzero(label == c) for c in range(classes)]
    each = -(-s.batch // classes)
    steps = max(s.steps, *(-(-len(own) // each) for own in by_class))
    turns = [np.concatenate([r.permutation(own) for _ in range(-(-steps * each // len(own)))]) for own in by_class]
    for step in range(1, steps + 1):
        pick = np.concatenate([own[(step - 1) * each : step * each] for own in turns])
        _, g = loss_and_gradients(p, both_ways(data, starts[pick], sizes[pick], s.piece), sizes[pick], label[pick])
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = s.rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, x in g.items():
            x = x * min(1.0, 1 / (size + 1e-12))
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def document_probabilities(p: Weights, block: T.Block, s: Settings) -> np.ndarray:
    """(documents, classes): averages over each document's letters; zero rows without letters."""
    data, offsets = block.data, block.offsets
    classes = p["out"].shape[2]
    n = np.diff(offsets)
    count = -(-n // s.span)
    doc = np.repeat(np.arange(len(n)), count)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[doc] + rank * s.span
    ends = np.minimum(starts + s.span, offsets[doc + 1])
    low, high = np.maximum(starts - s.around, offsets[doc]), np.minimum(ends + s.around, offsets[doc + 1])
    letters = T.LETTERS[data]
    total = np.zeros((len(n), classes))
    by_size = np.argsort(high - low, kind="stable")  # windows of like sizes go together, as all take as many steps as the longest
    for lo in range(0, len(doc), s.lanes):
        part = by_size[lo : lo + s.lanes]
        a, b = low[part], high[part] - low[part]
        width = int(b[-1])
        probability = position_probabilities(p, both_ways(data, a, b, width), b)
        at = a + np.minimum(np.arange(width)[:, None], b - 1)
        held = (np.arange(width)[:, None] < b) & (at >= starts[part]) & (at < ends[part]) & letters[at]
        for c in range(classes):
            total[:, c] += np.bincount(doc[part], np.where(held, probability[:, :, c], np.float32(0)).sum(axis=0), minlength=len(n))
    seen = T.per_document(letters, offsets)
    return total / np.maximum(seen, 1)[:, None]


def has_letter(block: T.Block) -> np.ndarray:
    """Whether each document has a letter of any script."""
    data, offsets = block.data, block.offsets
    ascii_ = T.per_document(T.LETTERS[data] & (data < 128), offsets) > 0
    for i in np.flatnonzero(~ascii_ & (T.per_document(data >= 128, offsets) > 0)):
        ascii_[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return ascii_


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 divided by 5, and for null ids: never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def pieces(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, and the starts, sizes and texts of the pieces of at most `width` bytes that they are cut into."""
    data, offsets = T.joined(column)
    n = np.diff(offsets)
    count = -(-n // width)
    doc = np.repeat(np.arange(len(n)), count)
    starts = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * width
    return data, starts, np.minimum(starts + width, offsets[doc + 1]) - starts, doc


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: Weights
    settings: Settings


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with id, text and language that aren't held out; see Settings for the bound.  Languages are few: their
    number, not that of documents, is what the driver counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("luck", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 11) / float(1 << 53))
    there = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(there))
    if len(languages) < 2:
        return Model(languages, {}, settings)
    # about twice as many as wanted by their luck, then the luckiest of them
    reach = F.create_map(*[F.lit(x) for lang, n in there.items() for x in (lang, min(1.0, (2 * settings.documents + 100) / n))])
    order = W.partitionBy("lang").orderBy("luck", "doc_id", "text")
    drawn = usable.where(F.col("luck") < F.element_at(reach, F.col("lang"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.documents)
    table = drawn.orderBy("lang", "rank").select("lang", "text").toArrow().combine_chunks()
    data, starts, sizes, doc = pieces(table.column("text").combine_chunks(), settings.piece)
    label = np.array([languages.index(x) for x in table.column("lang").to_pylist()])[doc]
    return Model(languages, train(data, starts, sizes, label, len(languages), settings), settings)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    for batch in batches:
        lang, score = [], []
        for block in T.blocks(batch.column("text")):
            some = has_letter(block)
            if model.weights:
                found = document_probabilities(model.weights, block, model.settings)
            else:
                found = np.full((len(block), len(model.languages)), 1.0)
            best = found.argmax(axis=1) if model.languages else np.zeros(len(block), dtype=int)
            top = found.max(axis=1) if model.languages else np.zeros(len(block))
            best = np.where(some & bool(model.languages), best, len(names) - 1)
            lang.extend(names[best])
            score.append(np.where(best == len(names) - 1, 0.0, np.clip(top, 0, 1)))
        keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, type=pa.string()), pa.array(np.concatenate(score) if score else [], type=pa.float64())], names=[*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id long, lang_pred string, score double.

    lang_pred is the learnt language with the highest average probability over the text's letters and
    score that probability; a null text or one without a letter is `und` with score 0, as is every
    text where no language was learnt.  Equal averages go to the first language by name.  Null ids and repeated rows
    each get their row; only id and text are read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(T.released(lambda batches: _predict(batches, model)), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, whose text has a language with a probability of at least `least`.  A text alone
    decides: repeated rows go or stay together, null texts and those without a letter go, rows with a null id are like others.
    Columns may have any names.  An empty table gives an empty one."""

    @F.arrow_udf("boolean")
    def likely(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            (found,) = _predict(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), model)
            known = np.asarray(found.column("lang_pred").to_numpy(zero_copy_only=False) != UNKNOWN, dtype=bool)
            yield pa.array(known & (found.column("score").to_numpy() >= least))

    return docs.where(likely(F.col(text_col).cast("string")))  # only texts go to Python, and one bit a row comes back
