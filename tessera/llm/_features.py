"""Hashed word features of texts, and small linear models over them."""

from __future__ import annotations

import numpy as np

from tessera.llm import _text as T

U64 = np.uint64


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capital letters of Latin-1 in lower case."""
    low = T.LOWER[data]
    if len(low) > 1:
        tail = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][tail] += 0x20
    return low


def letter_words(block: T.Block) -> tuple[T.Block, np.ndarray, np.ndarray, np.ndarray]:
    """The folded block, starts and ends of its runs of letters, and each document's first."""
    low = T.Block(folded(block.data), block.offsets, block.lo, block.hi)
    return low, *low.words(T.LETTERS)


def stem_hashes(low: T.Block, starts: np.ndarray, ends: np.ndarray, stems: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of whole words, then of their first bytes for each stem length; 0 for a word that isn't longer."""
    prefix = T.byte_prefix(low.data)
    out = [T.span_hashes(prefix, starts, ends)]
    for k in stems:
        longer = ends - starts > k
        h = T.mix(T.span_hashes(prefix, starts, np.minimum(starts + k, ends)) ^ U64(k))
        out.append(np.where(longer, h, U64(0)))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, pairs: np.ndarray | None = None, pull: float = 0.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last one the bias, of a logistic regression on dense rows with soft labels y: mean loss plus
    ridge / 2 |w|^2 (bias free) plus pull / 2 times the mean square of the score changes `pairs` @ w."""
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(full.shape[1])
    total = weight.sum()
    hold = np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
    if pairs is not None and len(pairs) and pull:
        change = np.concatenate([pairs, np.zeros((len(pairs), 1))], axis=1)
        hold += pull / len(pairs) * change.T @ change
    for _ in range(rounds):
        p = sigmoid(full @ w)
        g = full.T @ (weight * (p - y)) / total + hold @ w
        h = (full * (weight * p * (1 - p))[:, None]).T @ full / total + hold
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w -= step * min(1.0, 4 / (size + 1e-12))
        if size < 1e-6:
            break
    return w
