"""Small models for dense features, trained on the driver on a bounded sample: boosted trees and isotonic calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Gradient-boosted trees of logistic loss, with splits found in histograms of at most ``bins`` quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, threshold and value of each node

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight
        mean = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        margin = np.full(len(y), self.base)
        n_nodes = 2 ** (self.depth + 1) - 1
        for _ in range(self.n_trees):
            p = sigmoid(margin)
            g, h = w * (p - y), w * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, threshold, value = np.full(n_nodes, -1), np.zeros(n_nodes), np.zeros(n_nodes)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2:
                        continue
                    f, cut = self._split(binned[rows], g[rows], h[rows])
                    if f >= 0:
                        feature[k], threshold[k] = f, edges[f][cut]
                        node[rows] = 2 * k + 1 + (binned[rows, f] > cut)
            total_g, total_h = np.bincount(node, g, n_nodes), np.bincount(node, h, n_nodes)
            value = -self.rate * total_g / (total_h + self.l2)
            self.trees.append((feature, threshold, value))
            margin += value[node]
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, found = 1e-6, (-1, 0)
        all_g, all_h = g.sum(), h.sum()
        for f in range(binned.shape[1]):
            left_g = np.cumsum(np.bincount(binned[:, f], g, self.bins))[:-1]
            left_h = np.cumsum(np.bincount(binned[:, f], h, self.bins))[:-1]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + self.l2) + right_g**2 / (right_h + self.l2) - all_g**2 / (all_h + self.l2)
            gain[(left_h < self.least * 0.1) | (right_h < self.least * 0.1)] = 0
            cut = int(np.argmax(gain))
            if gain[cut] > best:
                best, found = gain[cut], (f, cut)
        return found

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out


class Isotonic:
    """A non-decreasing map from margins to frequencies (pool adjacent violators), drawn towards the mean where it saw few rows."""

    def fit(self, margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        m, mean = margin[order], float(y.mean()) if len(y) else 0.5
        blocks: list[list[float]] = []  # sum, rows, first and last margin
        for a, b in zip(m.tolist(), y[order].tolist()):
            if blocks and blocks[-1][3] == a:
                blocks[-1][0] += b
                blocks[-1][1] += 1
            else:
                blocks.append([b, 1, a, a])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, n, _, last = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += n
                blocks[-1][3] = last
        at, value = [], []
        for s, n, first, last in blocks:
            v = (s + prior * mean) / (n + prior)
            at += [first, last] if last > first else [first]
            value += [v, v] if last > first else [v]
        self.at, self.value = np.array(at or [0.0]), np.maximum.accumulate(np.array(value or [mean]))
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    values, inverse, n = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    positive = y[order] == 1
    p, q = int(positive.sum()), int((~positive).sum())
    return float((rank[positive].sum() - p * (p + 1) / 2) / (p * q)) if p and q else float("nan")
