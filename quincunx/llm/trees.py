"""Gradient-boosted trees for a few features, with monotonic constraints, as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees one after the other: a node with ``feature`` -1 is a leaf."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``, one step down all rows at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.feature[node] >= 0
                goes_left = x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
            total += self.value[node]
        return total


def fit(
    x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], *, trees: int = 40, depth: int = 3, rate: float = 0.2,
    bins: int = 32, ridge: float = 1.0, least: float = 4.0,
) -> Forest:
    """Boosts logistic loss.  ``monotone`` has +1, -1 or 0 for each feature: a greater value of
    the feature never lowers (+1) or raises (-1) the score, all else being equal."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if len(x) else x.astype(int)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(x), base)

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def gain_of(g, h, v):
        return -(g * v + 0.5 * (h + ridge) * v * v)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        number, own = len(nodes), weight(g[rows].sum(), h[rows].sum(), low, high)
        nodes.append([-1, 0.0, -1, -1, rate * own])
        margin[rows] += rate * own
        if level == depth:
            return number
        best = (1e-6, None)
        whole = gain_of(g[rows].sum(), h[rows].sum(), own)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))
            a = np.clip(-gl[:-1] / (hl[:-1] + ridge), low, high)
            b = np.clip(-(gl[-1] - gl[:-1]) / (hl[-1] - hl[:-1] + ridge), low, high)
            gain = gain_of(gl[:-1], hl[:-1], a) + gain_of(gl[-1] - gl[:-1], hl[-1] - hl[:-1], b) - whole
            allowed = (hl[:-1] * 4 >= least) & ((hl[-1] - hl[:-1]) * 4 >= least) & (monotone[f] * (b - a) >= 0)
            gain = np.where(allowed, gain, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(a[k]), float(b[k])))
        if best[1] is None:
            return number
        f, k, a, b = best[1]
        middle = (a + b) / 2
        left_high, right_low = (middle, middle) if monotone[f] > 0 else (high, low)
        left_low, right_high = (middle, middle) if monotone[f] < 0 else (low, high)
        margin[rows] -= rate * own
        goes_left = binned[rows, f] <= k
        left = grow(rows[goes_left], g, h, level + 1, left_low, left_high)
        right = grow(rows[~goes_left], g, h, level + 1, right_low, right_high)
        nodes[number] = [f, float(cuts[f][k]), left, right, 0.0]
        return number

    for _ in range(trees if len(x) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    flat = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    return Forest(
        np.array(roots, np.int64), np.array(flat[0], np.int64), np.array(flat[1], float), np.array(flat[2], np.int64),
        np.array(flat[3], np.int64), np.array(flat[4], float), depth, base,
    )
