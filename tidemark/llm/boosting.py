"""Gradient-boosted trees for a few classes, in numpy: softmax loss, histogram splits, second-order leaf values."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``fit`` on a bounded sample, ``proba`` on any number of rows. Trees are complete, of one depth, kept as arrays."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, ridge: float = 2.0, least: float = 0.5):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge = classes, rounds, depth, rate, bins, ridge
        self.least = least
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.temperature = 1.0
        self.bias = np.zeros(classes)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, f = x.shape
        # Half of the cuts at quantiles, half evenly over the range: a feature that is 0 for nearly all rows keeps its scale.
        half = self.bins // 2
        even = [np.linspace(x[:, j].min(), x[:, j].max(), half + 1)[1:-1] for j in range(f)]
        self.edges = [np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, half + 1)[1:-1]), even[j]])) for j in range(f)]
        codes = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(f)], 1)
        one = np.eye(self.classes)[y]
        prior = (one.sum(0) + 1) / (n + self.classes)
        self.start = np.log(prior)
        score = np.tile(self.start, (n, 1))
        weight = (1 / (one.sum(0) + 1))[y]
        weight *= n / weight.sum()
        for _ in range(self.rounds):
            p = self._softmax(score)
            trees = []
            for c in range(self.classes):
                g, h = weight * (p[:, c] - one[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree = self._tree(codes, g, h)
                trees.append(tree)
                score[:, c] += self._apply(tree, codes)
            self.trees.append(trees)
        # Thresholds on bin codes become thresholds on values.
        self.trees = [[(ft, np.array([self.edges[j][t] if t < len(self.edges[j]) else np.inf for j, t in zip(ft, th)]), lv) for ft, th, lv in ts] for ts in self.trees]
        return self

    def _tree(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray):
        nodes, f = 2**self.depth - 1, codes.shape[1]
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, self.bins, np.int64)
        at = np.zeros(len(g), np.int64)
        b = self.bins + 1
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, bf, bt = np.zeros(width), np.zeros(width, np.int64), np.full(width, self.bins, np.int64)
            for j in range(f):
                cell = local * b + codes[:, j]
                gs = np.bincount(cell, g, width * b).reshape(width, b).cumsum(1)
                hs = np.bincount(cell, h, width * b).reshape(width, b).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                best[better], bf[better], bt[better] = top[better], j, k[better]
            feature[first : first + width], threshold[first : first + width] = bf, bt
            at = 2 * at + 1 + (codes[np.arange(len(at)), feature[at]] > threshold[at])
        leaf = at - nodes
        leaves = 2**self.depth
        value = -self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.ridge)
        return feature, threshold, value

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        return value[at - len(feature)]

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for trees in self.trees:
            for c, tree in enumerate(trees):
                out[:, c] += self._apply(tree, x)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Temperature with the least log loss on checked rows."""
        s = self.scores(x)
        grid = np.geomspace(0.25, 8, 61)
        loss = [-np.log(np.clip(self._softmax(s / t)[np.arange(len(y)), y], 1e-9, 1)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def proba(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self.scores(x) / self.temperature) if len(x) else np.zeros((0, self.classes))
