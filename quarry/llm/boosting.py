"""Gradient-boosted trees over a few numbers for each row, with monotone constraints, in numpy.

Trees are grown level by level over binned features for the logistic loss, and flattened to arrays
of nodes; scoring walks all rows and trees down together. Where a feature is constrained, a split
that would go the wrong way is not taken, and the children's values are bounded by the middle of the
two, so that every tree, and their sum, is monotone in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Flattened nodes of all trees: rows of (trees, nodes); a leaf is its own child."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x (rows, features)."""
        out = np.full(len(x), self.base)
        for start in range(0, len(x), 65_536):
            part = x[start : start + 65_536]
            rows = np.arange(len(part))
            for tree in range(len(self.feature)):
                at = np.zeros(len(part), np.int64)
                for _ in range(self.depth):
                    below = part[rows, self.feature[tree, at]] <= self.bound[tree, at]
                    at = np.where(below, self.left[tree, at], self.right[tree, at])
                out[start : start + len(part)] += self.value[tree, at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least: int = 8) -> Trees:
    """Trees for labels y (0 or 1); monotone: +1, -1 or 0 for each feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    count = 2 ** (depth + 1) - 1
    feature, bound, value = np.zeros((trees, count), np.int64), np.full((trees, count), np.inf), np.zeros((trees, count))
    left, right = (np.tile(np.arange(count), (trees, 1)) for _ in range(2))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        members = {0: np.arange(len(y))}
        limits = {0: (-np.inf, np.inf)}
        for node in range(count):
            if node not in members:
                continue
            rows, (lo, hi) = members.pop(node), limits[node]
            g, h = grad[rows].sum(), hess[rows].sum()
            value[t, node] = np.clip(g / (h + ridge), lo, hi)
            if 2 * node + 2 >= count or len(rows) < 2 * least:
                continue
            best = (1e-6, -1, -1, 0.0, 0.0)
            for f in range(x.shape[1]):
                n = len(edges[f]) + 1
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                vl, vr = np.clip(gl / (hl + ridge), lo, hi), np.clip((g - gl) / (h - hl + ridge), lo, hi)
                gain = gl * vl - 0.5 * (hl + ridge) * vl**2 + (g - gl) * vr - 0.5 * (h - hl + ridge) * vr**2
                gain -= g * value[t, node] - 0.5 * (h + ridge) * value[t, node] ** 2
                gain[(nl < least) | (len(rows) - nl < least) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), f, i, float(vl[i]), float(vr[i]))
            _, f, i, vl, vr = best
            if f < 0:
                continue
            feature[t, node], bound[t, node] = f, edges[f][i]
            left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
            low = binned[rows, f] <= i
            members[2 * node + 1], members[2 * node + 2] = rows[low], rows[~low]
            middle = (vl + vr) / 2
            limits[2 * node + 1] = limits[2 * node + 2] = (lo, hi)
            if monotone[f]:
                down, up = (lo, middle), (middle, hi)
                limits[2 * node + 1], limits[2 * node + 2] = (down, up) if monotone[f] > 0 else (up, down)
        value[t] *= rate
        at = np.zeros(len(y), np.int64)
        rows = np.arange(len(y))
        for _ in range(depth):
            at = np.where(x[rows, feature[t, at]] <= bound[t, at], left[t, at], right[t, at])
        margin += value[t, at]
    return Trees(feature, bound, left, right, value, base, depth)
