"""Hashed character n-grams, and a sparse softmax trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

#: Characters of a text taken at a time; a text's n-grams are those of all its blocks, which overlap by the order less one.
BLOCK = 1 << 18
Sparse = tuple[np.ndarray, np.ndarray]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashed(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    mix = np.full(len(codes) - order + 1, order, np.uint64)
    for k in range(order):
        mix = (mix + codes[k : len(codes) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    return (mix >> np.uint64(64 - bits)).astype(np.int64)


def ngram_counts(text: str, orders: Sequence[int], bits: int) -> Sparse:
    """Distinct hashed n-grams of the whole text and their counts."""
    codes = _codes(text)
    total = None
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + max(orders) - 1]
        ids = [_hashed(part[: BLOCK + n - 1], n, bits) for n in orders if min(len(part), BLOCK + n - 1) >= n]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        if len(codes) <= BLOCK:
            return np.unique(ids, return_counts=True)
        counts = np.bincount(ids, minlength=1 << bits)
        total = counts if total is None else total + counts
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Softmax:
    """Weights by feature and class, a bias by class, and the temperature that logits are divided by."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, x: Sparse) -> np.ndarray:
        return x[1] @ self.weights[x[0]] + self.bias

    def probabilities(self, x: Sparse) -> np.ndarray:
        return softmax(self.logits(x) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    rows: Sequence[tuple[Sparse, int]], size: int, classes: int, epochs: int = 3, rate: float = 0.2, l1: float = 0.01, l2: float = 0.1
) -> Softmax:
    """FTRL-proximal with elastic net; one pass over the rows an epoch, in the order given, reshuffled by a fixed seed."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))  # the last row is the bias
    draw = np.random.default_rng(7)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((1.0 + np.sqrt(ni)) / rate + l2)

    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            (ids, values), label = rows[i]
            ids, values = np.append(ids, size), np.append(values, 1.0)
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            error = softmax(values @ w)
            error[label] -= 1.0
            g = values[:, None] * error
            g2 = g * g
            z[ids] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / rate * w
            n[ids] = ni + g2
    w = weights(z, n)
    return Softmax(w[:size].astype(np.float32), w[size])


def calibrate(model: Softmax, rows: Iterable[tuple[Sparse, int]]) -> float:
    """The temperature with the least log loss on rows that weren't trained on; 1 without rows."""
    pairs = [(model.logits(x), y) for x, y in rows]
    if not pairs:
        return 1.0
    logits, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    at = np.arange(len(y))
    loss = [-np.log(np.maximum(softmax(logits / t)[at, y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
