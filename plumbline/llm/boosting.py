"""Gradient-boosted trees over small integer features, with the logistic loss."""

from __future__ import annotations

import numpy as np

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int, least: float) -> Tree:
    """One tree as arrays over a complete binary tree: feature (or -1), bound (left if at most), value."""
    size = 2 ** (depth + 1) - 1
    feature, bound, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
    rows = {0: np.arange(len(x))}
    for node in range(size):
        r = rows.pop(node, None)
        if r is None:
            continue
        sg, sh = g[r].sum(), h[r].sum()
        value[node] = -sg / (sh + 1.0)
        if node >= 2**depth - 1 or len(r) < 2:
            continue
        best = (1e-6, -1, 0)
        for f in range(x.shape[1]):
            cg, ch = (np.cumsum(np.bincount(x[r, f], w[r], minlength=bins))[:-1] for w in (g, h))
            gain = cg**2 / (ch + 1.0) + (sg - cg) ** 2 / (sh - ch + 1.0) - sg**2 / (sh + 1.0)
            gain[(ch < least) | (sh - ch < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] >= 0:
            feature[node], bound[node] = best[1], best[2]
            left = x[r, best[1]] <= best[2]
            rows[2 * node + 1], rows[2 * node + 2] = r[left], r[~left]
    return feature, bound, value


class Boosted:
    """Fitted trees; ``probability`` of rows of the same features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, least: float = 1.0) -> None:
        x = x.astype(np.int64)
        bins = int(x.max()) + 2 if x.size else 2
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base, self.rate, self.depth = float(np.log(share / (1 - share))), rate, depth
        self.trees: list[Tree] = []
        z = np.full(len(x), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            t = _grow(x, p - y, p * (1 - p), depth, bins, least)
            self.trees.append(t)
            z += rate * self._apply(t, x)

    def _apply(self, tree: Tree, x: np.ndarray) -> np.ndarray:
        feature, bound, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            right = x[np.arange(len(x)), np.where(inner, f, 0)] > bound[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * self._apply(t, x)
        return 1 / (1 + np.exp(-z))
