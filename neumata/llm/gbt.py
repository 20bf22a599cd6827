"""Histogram gradient-boosted trees with a logistic loss, flattened into node arrays.

Fitting runs on a bounded sample; scoring walks all rows of a batch down every tree at once, as array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in arrays; a leaf points to itself, so a walk of `depth` steps ends in a leaf."""

    base: float
    depth: int = 0
    root: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x) or not len(self.root):
            return out
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return out + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray, step: int = 2048) -> np.ndarray:
        parts = [1 / (1 + np.exp(-np.clip(self.margin(x[k : k + step]), -30, 30))) for k in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 5.0, monotone: dict[int, int] | None = None) -> Trees:
    """monotone: column -> +1 (the score never falls as it grows) or -1 (never rises). No rows, or one class: a constant."""
    monotone = monotone or {}
    n = len(y)
    p = (float(y.sum()) + 0.5) / (n + 1)
    model = Trees(base=float(np.log(p / (1 - p))))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.int32)
    cols, offset = x.shape[1], np.arange(x.shape[1]) * bins
    sign = np.array([monotone.get(j, 0) for j in range(cols)])[:, None]
    margin = np.full(n, model.base)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []

    def leaf(v: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), v])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + l2), low, high))
        if level == depth or hs < 2 * least / 4:
            margin[rows] += rate * value
            return leaf(rate * value)
        flat = (binned[rows] + offset).ravel()
        hg = np.cumsum(np.bincount(flat, np.repeat(g[rows], cols), cols * bins).reshape(cols, bins), 1)[:, :-1]
        hh = np.cumsum(np.bincount(flat, np.repeat(h[rows], cols), cols * bins).reshape(cols, bins), 1)[:, :-1]
        vl, vr = np.clip(-hg / (hh + l2), low, high), np.clip(-(gs - hg) / (hs - hh + l2), low, high)
        gain = -(hg * vl + 0.5 * (hh + l2) * vl**2) - ((gs - hg) * vr + 0.5 * (hs - hh + l2) * vr**2) + (gs * value + 0.5 * (hs + l2) * value**2)
        ok = (hh >= least / 4) & (hs - hh >= least / 4) & (sign * (vr - vl) >= 0)
        gain = np.where(ok, gain, -np.inf)
        j, b = divmod(int(gain.argmax()), bins - 1)
        if not gain[j, b] > 1e-6 or b >= len(edges[j]):
            margin[rows] += rate * value
            return leaf(rate * value)
        go = binned[rows, j] <= b
        mid = float((vl[j, b] + vr[j, b]) / 2)
        lows, highs = (low, low), (high, high)
        if sign[j, 0] > 0:
            lows, highs = (low, mid), (mid, high)
        elif sign[j, 0] < 0:
            lows, highs = (mid, low), (high, mid)
        at = len(nodes)
        nodes.append([j, float(edges[j][b]), -1, -1, 0.0])
        nodes[at][2] = grow(rows[go], g, h, level + 1, lows[0], highs[0])
        nodes[at][3] = grow(rows[~go], g, h, level + 1, lows[1], highs[1])
        return at

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), prob - y, prob * (1 - prob), 0, -np.inf, np.inf))
    feature, cut, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(model.base, depth, np.array(roots, np.int32), feature.astype(np.int32), cut, left.astype(np.int32), right.astype(np.int32), value)
