"""Gradient-boosted regression trees for the logistic loss, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray             # trees x inner nodes
    threshold: np.ndarray           # go right if value > threshold
    leaf: np.ndarray                # trees x leaves
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        row = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            score += leaf[at - inner]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, penalty: float = 1.0) -> Trees:
    """Newton boosting: each level takes, per node, the split of the largest gain over all binned features."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score, inner = np.full(n, bias), 2 ** depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = 2 ** level - 1, 2 ** level
            local, best = at - first, np.zeros(k)
            for j in range(width):
                key = local * BINS + binned[:, j]
                gs = np.bincount(key, g, k * BINS).reshape(k, BINS)
                hs = np.bincount(key, h, k * BINS).reshape(k, BINS)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt ** 2 / (ht + penalty)
                gain = gain[:, :len(edges[j])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(1)
                top = gain[np.arange(k), cut]
                for node in np.flatnonzero(top > best + 1e-9).tolist():
                    best[node], feature[first + node], threshold[first + node] = top[node], j, edges[j][cut[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), bias)
