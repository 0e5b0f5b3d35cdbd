"""Mixing documents to target weights of domains that are only known softly.

A classifier learnt from a labelled table gives every document a probability for each domain.
Document rates r >= 0 are then fitted so that the expected tokens of each domain,
sum(r * tokens * probability), meet targets: projected gradient on the squared misses, each
measured against the domain's size.  A step adds the same combination of its probabilities to
every document's rate, so a rate is a function of a document's probabilities and of the few numbers that
the steps so far have sent out.  Nothing is kept by document, and each step is one aggregate.
Where the gradient is too slow, as with soft probabilities, Newton's method finds the one step
that leads from rates of 1 to the nearest rates that meet the targets.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _features as X
from tessera.llm import _text as T
from tessera.llm._tables import Tables, without

U64 = np.uint64
LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """`rows`: at most so many labelled texts of each domain, those with the smallest hashes of their ids, train the
    classifier; `bits` of a word feature's hash; `rounds` of projected gradient at most, until every
    domain's tokens are within `tolerance` of its target; where they aren't then, Newton's method follows."""

    rows: int = 2000
    bits: int = 16
    steps: int = 200
    rate: float = 0.5
    ridge: float = 1e-6
    rounds: int = 40
    tolerance: float = 1e-4


@dataclass(frozen=True)
class Model:
    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    settings: Settings


def features(block: T.Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lower-cased words, and each document's first."""
    starts, ends, first = block.words()
    low = T.span_hashes(T.byte_prefix(X.folded(block.data)), starts, ends)
    return (low >> U64(64 - bits)).astype(np.int64), first


def _shares(count: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Weights of words that a document has so often, damped and, of length 1 over each document."""
    damped = 1 + np.log(count)
    return damped / np.sqrt(np.bincount(doc, damped * damped, minlength=n))[doc]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(row: np.ndarray, ids: np.ndarray, shares: np.ndarray, label: np.ndarray, classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by Adagrad; row, ids, shares are a sparse matrix of feature shares."""
    n = len(label)
    w, b = np.zeros((1 << s.bits, classes)), np.zeros(classes)
    past, past_b = np.full(w.shape, 1e-8), np.full(classes, 1e-8)
    truth = np.eye(classes)[label]
    used = np.unique(ids)
    at = np.searchsorted(used, ids)
    small, past = w[used], past[used]
    for _ in range(s.steps):
        logits = np.stack([np.bincount(row, small[at, c] * shares, minlength=n) for c in range(classes)], axis=1) + b
        error = (_softmax(logits) - truth) / n
        g = np.stack([np.bincount(at, error[row, c] * shares, minlength=len(used)) for c in range(classes)], axis=1) + s.ridge * small
        past += g * g
        small = small - s.rate * g / np.sqrt(past)
        past_b += error.sum(axis=0) ** 2
        b = b - s.rate * error.sum(axis=0) / np.sqrt(past_b)
    w[used] = small
    return w, b


def _draw(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shares = [], []
        for block in T.blocks(batch.column("text")):
            found, first = features(block, bits)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                seen, n = np.unique(found[a:b], return_counts=True)
                ids.append(seen.astype(np.int32))
                shares.append(_shares(n, np.zeros(len(n), dtype=np.int64), 1).astype(np.float32))
        columns = [batch.column("doc_id"), batch.column("domain"), pa.array(ids, type=pa.list_(pa.int32())), pa.array(shares, type=pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "domain", "ids", "shares"])


def fit(docs: DataFrame, labels: DataFrame, domain: str | Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn domains from `labels`, a table of ids from which `domain` takes a domain's name; null names and ids, and
    null texts, are left out.  Of an id that is labelled twice the first domain by name counts."""
    name = F.col(domain) if isinstance(domain, str) else domain
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), name.cast("string").alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    there = {r.domain: r.n for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each domain
    names = sorted(there)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    if len(names) < 2:
        return Model(tuple(names) or ("all",), np.zeros((1 << settings.bits, 1), dtype=np.float32), np.zeros(1), settings)
    parts = [known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows) for d in names]  # bounded by the setting
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    drawn = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(lambda batches: _draw(batches, settings.bits), "doc_id long, domain string, ids array<int>, shares array<float>")
    table = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "ids").limit(settings.rows * len(names)).toArrow()
    ids, shares = ([x.values.to_numpy(zero_copy_only=False) for x in table.column(c)] for c in ("ids", "shares"))
    label = np.array([names.index(d) for d in table.column("domain").to_pylist()], dtype=np.int64)
    if not len(label):
        return Model(tuple(names), np.zeros((1 << settings.bits, len(names)), dtype=np.float32), np.zeros(len(names)), settings)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    w, b = train(row, np.concatenate(ids), np.concatenate(shares), label, len(names), settings)
    # the sample has as many of a rare domain as of others: back to how often they are labelled, where any text was drawn
    drawn_of = np.bincount(label, minlength=len(names))
    b += np.where(drawn_of > 0, np.log([there[d] for d in names]) - np.log(np.maximum(drawn_of, 1)), 0.0)
    return Model(tuple(names), w.astype(np.float32), b, settings)


def document_posteriors(model: Model, block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (documents, domains) and words of each document; without words those of the bias."""
    found, first = features(block, model.settings.bits)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(block)), n)
    seen, count = np.unique(doc << 32 | found, return_counts=True)
    weight = model.weights[seen & 0xFFFFFFFF] * _shares(count, seen >> 32, len(block))[:, None]
    logits = np.stack([np.bincount(seen >> 32, weight[:, c], minlength=len(block)) for c in range(len(model.domains))], axis=1)
    return _softmax(logits + model.bias), n


def _posteriors(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = [f"p{i}" for i in range(len(model.domains))]
    for batch in batches:
        parts = [document_posteriors(model, b) for b in T.blocks(batch.column(1))]
        p = np.concatenate([x for x, _ in parts]) if parts else np.zeros((0, len(names)))
        n = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(names)))], names=["doc_id", "n_tokens", *names])


def posteriors(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, n_tokens long, p0, p1, ... double) for every row: words `[^\\x20\\x09-\\x0D]+` are the tokens."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _posteriors(batches, model), "doc_id long, n_tokens long, " + ", ".join(f"p{i} double" for i in range(len(model.domains))))


def _rate(steps: list[list[float]], most: float | None) -> Column:
    """A document's rate after the steps sent out: from 1, each step projected onto [least, most], `least` being its own."""
    d = len(steps[0]) if steps else 0
    at = F.lit(1.0)
    if steps:
        moves = F.array(*[F.array(*map(F.lit, s)) for s in steps])
        move = lambda s: sum((F.element_at(s, i + 1) * F.col(f"p{i}") for i in range(d)), F.lit(0.0))
        bound = (lambda x: F.least(x, F.lit(float(most)))) if most is not None else (lambda x: x)
        at = F.aggregate(moves, F.lit(1.0), lambda r, s: bound(F.greatest(r - move(s), F.col("least"))))
    return at


def projected_gradient(sums: Callable[[list[list[float]]], np.ndarray], size: np.ndarray, target: np.ndarray, rounds: int, tolerance: float, start: tuple[list[list[float]], np.ndarray] | None = None) -> tuple[list[list[float]], np.ndarray]:
    """Steps that bring sums(steps), the expected tokens by domain at the rates so far, to `target`.

    The gradient of sum((tokens - target)^2 / size) / 2 for a document's rate, in the metric of its tokens, is
    probabilities @ (miss / size).  As a document's probabilities sum to 1 a step of length 1 never overshoots.
    """
    steps, now = (list(start[0]), start[1].copy()) if start else ([], size.copy())
    for _ in range(rounds):
        miss = now - target
        if np.all(np.abs(miss) <= tolerance * np.maximum(target, 1.0)):
            break
        steps.append((miss / np.maximum(size, 1e-12)).tolist())
        before, now = now, sums(steps)
        if np.all(np.abs(now - before) <= tolerance / 10 * np.maximum(size, 1.0)):  # as near as rates come
            break
    return steps, now


#: Weight of keeping rates near 1 against missing targets: so small that it only decides where targets leave rates open.
NEAR = 1e-9


def met(now: np.ndarray, target: np.ndarray, tolerance: float) -> bool:
    return bool(np.all(np.abs(now - target) <= tolerance * np.maximum(target, 1.0)))


def nearest_step(moments: Callable[[list[float]], tuple[float, np.ndarray, np.ndarray]], size: np.ndarray, target: np.ndarray, start: np.ndarray, tolerance: float, rounds: int = 200) -> tuple[list[float], np.ndarray, bool]:
    """The step that takes rates of 1 to the nearest rates that meet `target`, or come as near to it as rates can: the
    step, the expected tokens after it, and whether the conditions of that optimum hold.

    Minimal are sum((tokens - target)^2 / size) + NEAR * sum(document's tokens * (rate - 1)^2).  In the step x, one number a domain, its
    dual is convex and has the gradient target - tokens(x) + NEAR * size * x.  moments(x) gives sum(n * integral of the rate), sum(n * rate * p)
    and sum(n * p p') over documents whose rate isn't at a bound, n being tokens and p probabilities.
    """
    there = size > 0
    scale = np.sqrt(np.where(there, size, 1.0))

    def value(x: np.ndarray, area: float) -> float:
        return area + float(target @ x + NEAR / 2 * (size * x) @ x)

    x = np.where(there, start, 0.0)
    area, now, hessian = moments(x.tolist())
    for _ in range(rounds):
        slope = np.where(there, target - now + NEAR * size * x, 0.0)
        if met(now, target, tolerance) or np.all(np.abs(slope) <= tolerance / 10 * np.maximum(np.minimum(target, size), 1e-6 * size.sum())):
            return x.tolist(), now, True
        curve = hessian / np.outer(scale, scale) + NEAR * np.eye(len(x))
        move = -np.linalg.solve(curve, slope / scale) / scale
        length, cost = 1.0, value(x, area)
        while True:
            after = moments((x + length * move).tolist())
            if value(x + length * move, after[0]) <= cost + 1e-4 * length * float(slope @ move) + 1e-12 * abs(cost) or length < 1e-9:
                break
            length /= 2
        x, (area, now, hessian) = x + length * move, after
    return x.tolist(), now, False


def target_tokens(size: np.ndarray, weights: np.ndarray, total: float | None, whole: int | None = None) -> np.ndarray:
    """Tokens to aim at: `weights` of `total`, by default of the most that needs no domain more often than it is there.
    Domains without tokens have no target, and the others share.  With `whole`, a domain with tokens and a weight, the
    total is what makes all of that domain its share, and of a domain that has less than its share all is the target."""
    weights = np.where(size > 0, weights, 0.0)
    if not weights.sum():
        return np.zeros(len(size))
    weights = weights / weights.sum()
    if total is None and whole is not None and weights[whole] > 0:
        return np.minimum(weights * (size[whole] / weights[whole]), size)
    if total is None:
        total = float(np.min(size[weights > 0] / weights[weights > 0]))
    return weights * total


def mix(docs: DataFrame, model: Model, weights: dict[str, float], total: float | None = None, most: float | None = None, whole: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id long, n_tokens long, domain string (the likeliest), p_<domain> double, rate double.

    rate >= 0 (and <= `most`, if given) is how often the document should be drawn.  weights are the domains' shares
    of tokens to aim at, scaled to 1; domains that aren't named get none.  Targets are those of target_tokens().  With `whole`,
    documents that are likeliest of that domain have a rate of 1 at least, as have those of domains with less than their share; these count
    as that domain with all their tokens, and the other domains' tokens in all other documents are held to their shares beside it.  Null and empty texts have no tokens and
    the rate of a document like the average.  Null ids and repeated rows each get their row; only id and
    text are read.  An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "mixing")
    posterior = tables.written(posteriors(docs, model, id_col, text_col))
    d, n = len(model.domains), F.col("n_tokens")
    likeliest = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position(F.array(*[f"p{i}" for i in range(d)]), F.greatest(*[f"p{i}" for i in range(d)]) if d > 1 else F.col("p0")).cast("int"))
    size = np.array([x or 0.0 for x in posterior.agg(*[F.sum(n * F.col(f"p{i}")) for i in range(d)]).first()])
    aim = np.array([weights.get(name, 0.0) for name in model.domains])
    at = model.domains.index(whole) if whole in model.domains and total is None else None
    at = None if at is None or not size[at] * aim[at] else at
    target, free = target_tokens(size, aim, total, at), np.ones(d, dtype=bool)
    marked = posterior.withColumn("domain", likeliest).withColumn("least", F.lit(0.0))
    if at is not None:  # documents of this domain and of scarce ones aren't thinned, and count as what they likeliest are
        free = target < size
        kept = F.col("domain").isin(*[F.lit(name) for name, x in zip(model.domains, free, strict=True) if not x])
        marked = marked.withColumn("least", kept.cast("double")).withColumns({f"q{i}": F.when(kept, (F.col("domain") == name).cast("double")).otherwise(F.col(f"p{i}")) for i, name in enumerate(model.domains)})
        own = F.sum(F.when(F.col("domain") == whole, n))
        *size, of_whole = (x or 0.0 for x in marked.agg(*[F.sum(n * F.col(f"q{i}")) for i in range(d)], own).first())
        size = np.array(size)
        target = np.where(free, np.minimum(aim / aim[at] * of_whole, size), size)
        marked = marked.withColumns({f"p{i}": F.col(f"q{i}") for i in range(d)} | {f"soft{i}": F.col(f"p{i}") for i in range(d)})

    def sums(steps: list[list[float]]) -> np.ndarray:
        rated = marked.select(*[f"p{i}" for i in range(d)], (_rate(steps, most) * n).alias("t"))
        return np.array([x or 0.0 for x in rated.agg(*[F.sum(F.col("t") * F.col(f"p{i}")) for i in range(d)]).first()])

    def moments(step: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
        moved = F.lit(1.0) - sum((F.lit(s) * F.col(f"p{i}") for i, s in enumerate(step)), F.lit(0.0))
        rate = _rate([step], most)
        area = n * (rate * rate / 2 + rate * (moved - rate))
        inside = n * ((moved > F.col("least")) & (moved < (float(most) if most is not None else float("inf")))).cast("int")
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        rated = marked.select(area.alias("area"), *[(n * rate * F.col(f"p{i}")).alias(f"s{i}") for i in range(d)], *[(inside * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"h{i}_{j}") for i, j in pairs])
        found = np.array([x or 0.0 for x in rated.agg(*map(F.sum, rated.columns)).first()])
        hessian = np.zeros((d, d))
        for (i, j), x in zip(pairs, found[1 + d :], strict=True):
            hessian[i, j] = hessian[j, i] = x
        return float(found[0]), found[1 : 1 + d], hessian

    def held(now: np.ndarray) -> np.ndarray:
        return np.where(free, now, target)  # no miss, so no step

    def held_moments(step: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
        area, now, hessian = moments(step)
        return area, held(now), hessian * np.outer(free, free)

    tolerance = model.settings.tolerance
    steps, now = projected_gradient(lambda s: held(sums(s)), size, target, model.settings.rounds, tolerance, ([], held(size))) if size.sum() else ([], size)
    if size.sum() and not met(now, target, tolerance):
        step, now, best = nearest_step(held_moments, size, target, np.where(free, np.sum(steps, axis=0) if steps else 0.0, 0.0), tolerance)
        steps = [step]
        if not met(now, target, tolerance):
            LOG.warning("targets are missed: %s", "rates come no nearer" if best else "rates didn't settle")
    LOG.info("expected tokens and targets: %s", {name: (float(a), float(b)) for name, a, b in zip(model.domains, now, target, strict=True)})
    return marked.select("doc_id", "n_tokens", "domain", *[F.col(f"soft{i}" if at is not None else f"p{i}").alias(f"p_{name}") for i, name in enumerate(model.domains)], _rate(steps, most).alias("rate"))


def drawn(docs: DataFrame, model: Model, weights: dict[str, float], total: float | None = None, most: float | None = None, whole: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, each as often as its rate says: the whole part of it, and once more with the chance of the rest.  A
    hash of the id decides, so rows of one id fare alike (by the largest of their rates); rows with a null id stay once.  With `most` 1 no row
    is repeated.  Columns may have any names.  An empty table gives an empty one."""
    rates = mix(docs, model, weights, total, most, whole, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("rate"))
    luck = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mixing")), 11) / float(1 << 53)
    copies = rates.select("doc_id", (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("long")).cast("int").alias("copies"))
    own = F.col(id_col).cast("long")
    if most is not None and most <= 1:
        return without(docs, own, copies.where("copies = 0").select("doc_id"))
    rows = docs.select(F.struct("*").alias("row"), own.alias("doc_id")).join(copies, "doc_id", "left")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.coalesce("copies", F.lit(1))))).select("row.*")
