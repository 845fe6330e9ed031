"""Gradient-boosted trees with a logistic loss on binned features; small, exact, numpy only."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of one depth: per tree a feature and a cut for each inner node and a value for each leaf."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.depth, self.feature, self.cut, self.leaf = base, depth, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (len(v) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 45, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Trees:
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = np.average(y, weights=weight)
    base = float(np.log(mean / (1 - mean)))
    margin, inner = np.full(n, base), 2**depth - 1
    features, points, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = weight * (y - p), weight * p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-6)
            for j in range(d):
                k = len(cuts[j]) + 1
                if k < 2:
                    continue
                cell = (at - first) * k + code[:, j]
                gs, hs = (np.bincount(cell, v, wide * k).reshape(wide, k).cumsum(axis=1) for v in (g, h))
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                top = gain.argmax(axis=1)
                value = gain[np.arange(wide), top]
                for i in np.flatnonzero(value > best):
                    best[i], features[t, first + i], points[t, first + i] = value[i], j, cuts[j][top[i]]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > points[t, at])
        leaf = at - inner
        leaves[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += leaves[t][leaf]
    return Trees(base, depth, features, points, leaves)
