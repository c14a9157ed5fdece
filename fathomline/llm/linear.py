"""Logistic regression on hashed n-grams, trained in numpy on a bounded sample, scored over slices of Arrow bytes.

A text's value in a feature is the share of its n-grams of that kind (words, word pairs, 4-byte runs) hashed there, so a
score is the bias plus the mean weight of the n-grams of each kind; a text of any length is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fathomline.llm.text import U, mix, segment_sums, shingles, words

BITS = 16
KINDS = 3


def ngrams(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, text of each) for each kind."""
    w = words(data, at, lower=True)
    out = [(w.hash, w.doc), shingles(w, 2)]
    n = len(data) - 3
    if n > 0:
        d = data.astype(np.uint32)
        run = d[:n] | (d[1 : n + 1] << np.uint32(8)) | (d[2 : n + 2] << np.uint32(16)) | (d[3 : n + 3] << np.uint32(24))
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        inside = text[:n] == text[3:]
        out.append(((run[inside] * np.uint32(2654435761)).astype(U) << U(32), text[:n][inside]))
    else:
        out.append((np.zeros(0, U), np.zeros(0, np.int64)))
    size = U(1 << BITS)
    return [((h >> U(64 - BITS)).astype(np.int64) + k * (1 << BITS), t) for k, (h, t) in enumerate(out)]


def score(weights: np.ndarray, bias: float, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    total = np.full(n, bias)
    for feature, text in ngrams(data, at):
        counts = np.bincount(text, minlength=n)
        ends = np.concatenate([[0], np.cumsum(counts)])
        total += segment_sums(weights[feature].astype(np.float64), ends) / np.maximum(counts, 1)
    return total


def features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, value) of each text, as it is trained on."""
    n = len(at) - 1
    rows: list[list] = [[] for _ in range(n)]
    for feature, text in ngrams(data, at):
        key, count = np.unique(text * (KINDS << BITS) + feature, return_counts=True)
        doc = key // (KINDS << BITS)
        share = count / np.maximum(np.bincount(text, minlength=n), 1)[doc]
        ends = np.searchsorted(doc, np.arange(n + 1))
        for i in range(n):
            s = slice(ends[i], ends[i + 1])
            rows[i].append((key[s] % (KINDS << BITS), share[s]))
    return [(np.concatenate([a for a, _ in r]).astype(np.int32), np.concatenate([b for _, b in r]).astype(np.float32)) for r in rows]


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows) -> np.ndarray:
        return np.array([self.weights[i] @ v for i, v in rows]) + self.bias if rows else np.zeros(0)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        """Platt's calibration of the raw score."""
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -50, 50)))


#: Value that the bias is trained as the weight of: near a text's own norm, so that it does not set the step length alone.
CONSTANT = 0.3
#: Values of whole examples that a training step takes at once.
BLOCK = 1 << 19


def fit(rows, y: np.ndarray, size: int, rounds: int = 150, ridge: float = 1e-5, start: Logistic | None = None) -> Logistic:
    """Accelerated gradient descent over the whole sample, classes weighted alike, from `start` if given; rows: (features, values) of each example.

    The step is the inverse of the loss's curvature bound. A feature moves by its share of the texts, so rare ones, which would learn the sample by heart, stay small.
    Examples of fewer than two classes teach nothing: all weights are zero.
    """
    y = np.asarray(y, float)
    if not len(rows) or y.min() == y.max():
        return Logistic(np.zeros(size, np.float32), 0.0)
    lens = np.array([len(i) for i, _ in rows])
    at = np.concatenate([[0], np.cumsum(lens)])
    blocks, first = [], 0
    while first < len(rows):
        end = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        own = rows[first:end]
        blocks.append((slice(first, end), np.concatenate([i for i, _ in own]).astype(np.int32), np.concatenate([v for _, v in own]).astype(np.float32), at[first : end + 1] - at[first]))
        first = end
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    norm = np.concatenate([segment_sums(v.astype(np.float64) ** 2, a) for _, _, v, a in blocks])
    step = 4 / (float((share * norm).sum()) + CONSTANT**2 + ridge)
    w = np.zeros(size + 1) if start is None else np.append(start.weights.astype(np.float64), start.bias / CONSTANT)
    ahead, pace = w.copy(), 1.0
    for _ in range(rounds):
        g = ridge * ahead
        for part, index, value, a in blocks:
            p = 1 / (1 + np.exp(-np.clip(segment_sums(value * ahead[index], a) + CONSTANT * ahead[-1], -50, 50)))
            error = (p - y[part]) * share[part]
            g[:-1] += np.bincount(index, value * np.repeat(error, np.diff(a)), size)
            g[-1] += CONSTANT * error.sum()
        new, faster = ahead - step * g, (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = new + (pace - 1) / faster * (new - w)
        w, pace = new, faster
    return Logistic(w[:-1].astype(np.float32), float(CONSTANT * w[-1]))


def calibrate(model: Logistic, raw: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt scaling on held-out scores: Newton's method with his smoothed targets."""
    y = np.asarray(y, float)
    if len(raw) < 2 or y.min() == y.max():
        return model
    good, bad = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(np.abs(raw).max(), 1e-9)
    x = np.stack([raw / scale, np.ones(len(raw))], 1)
    a = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * a)
        a += np.clip(step, -5, 5)
    model.slope, model.shift = float(max(a[0], 1e-3) / scale), float(a[1])
    return model


def spread(doc_id: np.ndarray) -> np.ndarray:
    """A fixed uniform number in [0, 1) for each id."""
    return mix(np.asarray(doc_id).astype(np.int64).view(U)).astype(np.float64) / 2.0**64
