"""Gradient-boosted trees for binary labels: trained on a bounded sample, scored from flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth. Node i of a tree has children 2i+1 and 2i+2; leaves follow the inner nodes."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes): right if the value is greater
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        total = np.full(len(x), self.base)
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, monotone: dict[int, int] | None = None, min_hessian: float = 1.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over binned features.

    monotone[f] is 1 if the score may only rise with feature f, -1 if it may only fall: such splits need ordered
    children, and each child keeps to its side of the middle of both, so the whole tree is monotonic.
    """
    x, y, monotone = np.asarray(x, float), np.asarray(y, float), monotone or {}
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
    inner, size = 2**depth - 1, bins + 1
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(mean / (1 - mean))))
    margin = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node, bounds = np.zeros(n, np.int64), {0: (-np.inf, np.inf)}
        for i in range(inner):
            low, high = bounds[i]
            mine = np.flatnonzero(node == i)
            bounds[2 * i + 1] = bounds[2 * i + 2] = (low, high)
            best = (1e-9, -1, -1, 0.0, 0.0)
            g, h = gradient[mine], hessian[mine]
            for f in range(width) if len(mine) else ():
                gl = np.cumsum(np.bincount(binned[f, mine], g, size))[: len(edges[f])]
                hl = np.cumsum(np.bincount(binned[f, mine], h, size))[: len(edges[f])]
                gr, hr = g.sum() - gl, h.sum() - hl
                left, right = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
                parent = np.clip(-g.sum() / (h.sum() + ridge), low, high)
                loss = lambda v, a, b: a * v + 0.5 * (b + ridge) * v * v
                gain = loss(parent, g.sum(), h.sum()) - loss(left, gl, hl) - loss(right, gr, hr)
                gain[(hl < min_hessian) | (hr < min_hessian) | (monotone.get(f, 0) * (right - left) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), f, k, float(left[k]), float(right[k]))
            _, f, k, left, right = best
            if f < 0:
                node[mine] = 2 * i + 1
                continue
            out.feature[t, i], out.threshold[t, i] = f, edges[f][k]
            node[mine] = 2 * i + 1 + (binned[f, mine] > k)
            if sign := monotone.get(f, 0):
                middle = (left + right) / 2
                under, over = (low, middle), (middle, high)
                bounds[2 * i + 1], bounds[2 * i + 2] = (under, over) if sign > 0 else (over, under)
        for leaf in range(inner + 1):
            mine = node == leaf + inner
            if mine.any():
                value = -gradient[mine].sum() / (hessian[mine].sum() + ridge)
                out.leaf[t, leaf] = rate * np.clip(value, *bounds[leaf + inner])
        margin += out.leaf[t, node - inner]
    return out


def split_rows(keys: np.ndarray, share: int = 4) -> np.ndarray:
    """True for the rows held out, chosen by key alone."""
    return folds(keys, share) == 0


def folds(keys: np.ndarray, count: int) -> np.ndarray:
    """The fold of each row, chosen by key alone."""
    return ((np.asarray(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(count)).astype(int)


def safe_threshold(scores: np.ndarray, labels: np.ndarray, false_rate: float, least: float = 0.5) -> float:
    """The score above which at most false_rate of the held-out negative rows lie, and least at least."""
    negative = np.sort(scores[labels == 0])
    if not len(negative):
        return least
    return max(least, float(negative[min(len(negative) - 1, int(np.ceil((1 - false_rate) * len(negative))) - 1)]))
