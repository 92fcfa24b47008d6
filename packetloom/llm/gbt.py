"""Histogram gradient-boosted trees in numpy: fitted on a bounded matrix, flattened for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    edges: list[np.ndarray]  # of each feature's bins
    feature: np.ndarray  # trees x nodes; -1: a leaf
    split: np.ndarray  # bins up to this one go left
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row, all trees level by level in whole arrays."""
        bins = binned(x, self.edges)
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, split, value in zip(self.feature, self.split, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = bins[rows, np.maximum(f, 0)] > split[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.empty((len(x), 0), np.uint8)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, n_bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Forest:
    """Logistic loss; x finite, y of 0 and 1.  Ties between splits go to the first feature and bin.  Without
    rows, or with one class only, the forest answers with the smoothed share of class 1."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    nodes = 2 ** (depth + 1) - 1
    if n == 0 or share * (n + 1) < 1 or (1 - share) * (n + 1) < 1:
        return Forest([np.empty(0)] * width, np.full((0, nodes), -1), np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), float(np.log(share / (1 - share))), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(width)]
    bins = binned(x, edges).astype(np.int64)
    total = np.full(n, np.log(share / (1 - share)))
    feature, split, value = (np.zeros((trees, nodes), t) for t in (np.int64, np.int64, np.float64))
    feature[:] = -1
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        alive = np.ones(n, bool)
        for level in range(depth + 1):
            first, count = 2**level - 1, 2**level
            local = node - first
            rows = np.flatnonzero(alive)
            sum_g = np.bincount(local[rows], g[rows], count)
            sum_h = np.bincount(local[rows], h[rows], count)
            value[t, first : first + count] = -rate * sum_g / (sum_h + l2)
            if level == depth or not len(rows):
                break
            gain = np.full((count, width), 1e-6)
            where = np.zeros((count, width), np.int64)
            for j in range(width):
                at = local[rows] * n_bins + bins[rows, j]
                left_g = np.bincount(at, g[rows], count * n_bins).reshape(count, n_bins).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(at, h[rows], count * n_bins).reshape(count, n_bins).cumsum(axis=1)[:, :-1]
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                better = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (sum_g**2 / (sum_h + l2))[:, None]
                better[(left_h < least * 0.1) | (right_h < least * 0.1)] = 0
                where[:, j] = better.argmax(axis=1)
                gain[:, j] = better.max(axis=1)
            best = gain.argmax(axis=1)
            splits = gain[np.arange(count), best] > 1e-5
            feature[t, first : first + count] = np.where(splits, best, -1)
            split[t, first : first + count] = where[np.arange(count), best]
            alive &= splits[np.minimum(np.maximum(local, 0), count - 1)]
            rows = np.flatnonzero(alive)
            f = feature[t, node[rows]]
            node[rows] = 2 * node[rows] + 1 + (bins[rows, f] > split[t, node[rows]])
        total += value[t, node]
    return Forest(edges, feature, split, value, float(np.log(share / (1 - share))), depth)
