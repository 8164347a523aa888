"""Gradient-boosted regression trees for two classes, over binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by heap position: feature, threshold, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value) + 1)) - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, leaf: float = 5.0, shrink: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; full binary trees of the given depth."""
    n, features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    rate_one = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(edges, float(np.log(rate_one / (1 - rate_one))))
    margin = np.full(n, model.base)
    size = 2 ** (depth + 1) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            count = 2**level
            gains = np.full((count, features, BINS), -np.inf)
            for f in range(features):
                key = (node - first) * BINS + bins[:, f]
                gs = np.bincount(key, g, count * BINS).reshape(count, BINS).cumsum(1)
                hs = np.bincount(key, h, count * BINS).reshape(count, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + shrink) + (gt - gs) ** 2 / (ht - hs + shrink) - gt**2 / (ht + shrink)
                gains[:, f] = np.where((hs >= leaf) & (ht - hs >= leaf), gain, -np.inf)
                gains[:, f, len(edges[f]) :] = -np.inf
            best = gains.reshape(count, -1).argmax(1)
            for k in range(count):
                if gains[k].flat[best[k]] > 1e-6:
                    f, b = divmod(int(best[k]), BINS)
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - (2**depth - 1)
        gs, hs = np.bincount(at, g, 2**depth), np.bincount(at, h, 2**depth)
        value[2**depth - 1 :] = -rate * gs / (hs + shrink)
        model.trees.append((feature, threshold, value))
        margin += value[node]
    return model
