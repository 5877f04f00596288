"""Gradient-boosted trees for two classes, in numpy: histogram splits, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees of one depth: node ``i`` has the children 2i+1 and 2i+2."""

    base: float
    features: np.ndarray  # tree, inner node
    cuts: np.ndarray
    leaves: np.ndarray  # tree, leaf
    slope: float = 1.0  # calibration of the summed score
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaves.shape[1]))
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Trees on (x, y); y is 0 or 1. Deterministic."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)  # value > edges[b] iff bin > b
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(rows) > 4:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(m):
                    k = len(edges[j])
                    if not k:
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], k + 1))[:k]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], k + 1))[:k]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, float(edges[j][b]))
            features[t, node], cuts[t, node] = best[1:]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        leaves[t] = value
        score += value[leaf]
    return Boosted(base, features, cuts, leaves)


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> Boosted:
    """Sets slope and shift by logistic regression of y on the raw score of held-out rows."""
    s = model.raw(x)
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        r = target - p
        hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(r * s).sum(), r.sum()]))
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the held-out precision is reached; just above all if none reaches it."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[np.diff(probability[order]) != 0, True]  # equal probabilities are in or out together
    good = np.flatnonzero((right >= precision) & last)
    return float(probability[order][good[-1]]) if len(good) else float(np.nextafter(probability.max(), 2))
