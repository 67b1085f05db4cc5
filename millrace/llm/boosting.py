"""Gradient-boosted trees for binary labels, in numpy: logistic loss, binned features, small depth."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 24
    smoothing: float = 1.0
    base: float = 0.0
    #: A tree is (feature, threshold) of its inner nodes, in heap order, and the values of its leaves.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x (rows, features), y 0 or 1.  Ties go to the first feature and threshold, so fits repeat."""
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-9)
                for j in range(m):
                    k = len(cuts[j]) + 1
                    cell = at * k + binned[:, j]
                    g = np.bincount(cell, grad, width * k).reshape(width, k)
                    h = np.bincount(cell, hess, width * k).reshape(width, k)
                    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                    gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                    s = self.smoothing
                    gain = gl**2 / (hl + s) + (gt - gl) ** 2 / (ht - hl + s) - gt**2 / (ht + s)
                    if gain.shape[1]:
                        c = gain.argmax(axis=1)
                        better = gain[np.arange(width), c] > best
                        best = np.where(better, gain[np.arange(width), c], best)
                        feature[first : first + width][better] = j
                        threshold[first : first + width][better] = cuts[j][c[better]]
                node = first + at
                at = 2 * at + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = np.bincount(at, grad, 2**self.depth) / (np.bincount(at, hess, 2**self.depth) + self.smoothing)
            self.trees.append((feature, threshold, self.rate * leaf))
            score += self.rate * leaf[at]
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The log odds of label 1."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (x[rows, feature[node]] > threshold[node])
            out += leaf[at]
        return out
