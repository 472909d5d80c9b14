"""Small learners on dense features: gradient-boosted trees, isotonic calibration. Driver-side fit, vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Trees of equal depth over binned features: per tree, heap-ordered features, cut values and leaf values."""

    base: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.features.shape[1] if self.features.size else 0
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:  # all rows are at the same depth
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 8, ridge: float = 1.0) -> Boosted:
    """Logistic loss, second-order gains on histograms, depth-wise trees."""
    n, k = x.shape
    prior = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    inner, size = 2**depth - 1, 2**depth
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1) if k else np.zeros((n, 0), int)
    width = bins + 1
    score, out = np.full(n, base), []
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, int)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = node - first
            gain_of = np.full(many, 1e-9)
            pick = np.zeros(many, int), np.full(many, width)
            for j in range(k):
                if not len(edges[j]):
                    continue
                key = at * width + binned[:, j]
                hist = [np.bincount(key, w, many * width).reshape(many, width).cumsum(1) for w in (g, h, np.ones(n))]
                total = [a[:, -1:] for a in hist]
                left, right = hist, [t - a for t, a in zip(total, hist, strict=True)]
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
                gain[(left[2] < least) | (right[2] < least)] = -1
                gain[:, len(edges[j]) :] = -1
                best = gain.argmax(1)
                value = gain[np.arange(many), best]
                better = value > gain_of
                gain_of[better], pick[0][better], pick[1][better] = value[better], j, best[better]
            for m in range(many):
                if pick[1][m] < width:
                    feature[first + m], cut[first + m] = pick[0][m], edges[pick[0][m]][pick[1][m]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = rate * np.bincount(leaf_of, g, size) / (np.bincount(leaf_of, h, size) + ridge)
        score += leaf[leaf_of]
        out.append((feature, cut, leaf))
    stack = lambda i: np.array([t[i] for t in out]) if out else np.zeros((0, 0))
    return Boosted(base, stack(0).astype(int), stack(1), stack(2))


def isotonic(score: np.ndarray, y: np.ndarray, pad: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators. Knots (score, probability) for ``calibrated``; ``pad`` virtual rows of the mean smooth each pool."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    at, first, count = np.unique(s, return_index=True, return_counts=True)
    total = np.add.reduceat(v, first)
    pools: list[list[float]] = []  # sum, weight, first score, last score
    for a, t, c in zip(at, total, count, strict=True):
        pools.append([t, c, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, c2, _, last = pools.pop()
            pools[-1][0] += t2
            pools[-1][1] += c2
            pools[-1][3] = last
    mean = float(v.mean())
    xs = np.array([x for p in pools for x in (p[2], p[3])])
    ys = np.array([(p[0] + pad * mean) / (p[1] + pad) for p in pools for _ in (0, 1)])
    return xs, np.maximum.accumulate(ys)


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(score, *knots), 0.0, 1.0)
