"""Gradient-boosted trees for binary labels, in numpy: histograms, logistic loss, Platt calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited regression trees on quantile bins, fitted to the log-loss one after another."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.start)
        self.nodes = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(b, y - p, p * (1 - p))
            self.nodes.append(tree)
            z += self._walk(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1).reshape(len(x), len(self.edges))

    def _grow(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> list[tuple[int, int, float]]:
        """A full tree as (feature, bin, value) of each node in heap order; feature -1: a leaf."""
        size = 2 ** (self.depth + 1) - 1
        tree = [(-1, 0, 0.0)] * size
        where = {0: np.arange(len(b))}
        for node in range(size):
            rows = where.pop(node, None)
            if rows is None:
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, -1, 0)
            if node < 2**self.depth - 1 and len(rows) >= 2 * self.least:
                for f in range(b.shape[1]):
                    k = b[rows, f]
                    n = np.cumsum(np.bincount(k, minlength=self.bins))[:-1]
                    gl = np.cumsum(np.bincount(k, weights=grad[rows], minlength=self.bins))[:-1]
                    hl = np.cumsum(np.bincount(k, weights=hess[rows], minlength=self.bins))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), f, at)
            _, f, at = best
            if f < 0:
                tree[node] = (-1, 0, float(self.rate * g / (h + self.ridge)))
            else:
                tree[node] = (f, at, 0.0)
                left = b[rows, f] <= at
                where[2 * node + 1], where[2 * node + 2] = rows[left], rows[~left]
        return tree

    def _walk(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        f, cut, value = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            inner = f[at] >= 0
            right = b[np.arange(len(b)), np.maximum(f[at], 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def decision(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        z = np.full(len(x), self.start)
        for tree in self.nodes:
            z += self._walk(tree, b)
        return z


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic calibration of decision values, by Newton's method."""
    a, c = 1.0, 0.0
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -35, 35)))
        d, w = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * z).sum(), d.sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(c)
