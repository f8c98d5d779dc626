"""Gradient-boosted decision trees for two classes, with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: a node sends a row right where ``x[feature] > threshold``."""

    start: float
    features: np.ndarray  # tree, inner node
    thresholds: np.ndarray
    leaves: np.ndarray  # tree, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, features[node]] > thresholds[node])
            total += leaves[node - (len(leaves) - 1)]
        return total


def fit(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 32,
    damping: float = 1.0,
) -> Trees:
    """Newton boosting of the logistic loss over quantile bins; ``y`` is 0 or 1."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1)
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model = Trees(
        float(np.log(share / (1 - share))),
        np.zeros((trees, 2**depth - 1), np.int64),
        np.full((trees, 2**depth - 1), np.inf),
        np.zeros((trees, 2**depth)),
    )
    margin = np.full(n, model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            local = node - first
            gains = np.full((width, size), 0.0)
            cuts = np.full((width, size), -1)
            for f in range(width):
                if not len(edges[f]):
                    continue
                slots, many = local * bins + binned[:, f], size * bins
                g = np.bincount(slots, gradient, many).reshape(size, bins)
                h = np.bincount(slots, curvature, many).reshape(size, bins)
                gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gr, hr = ga - gl, ha - hl
                gain = gl**2 / (hl + damping) + gr**2 / (hr + damping) - ga**2 / (ha + damping)
                gain[(hl < 1e-3) | (hr < 1e-3)] = 0
                cuts[f] = gain.argmax(1)
                gains[f] = gain.max(1)
            best = gains.argmax(0)
            for k in range(size):
                f = int(best[k])
                if gains[f, k] > 1e-6 and cuts[f, k] < len(edges[f]):
                    model.features[t, first + k] = f
                    model.thresholds[t, first + k] = edges[f][cuts[f, k]]
            node = 2 * node + 1 + (x[np.arange(n), model.features[t, node]] > model.thresholds[t, node])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, gradient, 2**depth), np.bincount(leaf, curvature, 2**depth)
        model.leaves[t] = -rate * g / (h + damping)
        margin += model.leaves[t][leaf]
    return model
