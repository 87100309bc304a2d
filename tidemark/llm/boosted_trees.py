"""Gradient-boosted trees for two classes with monotonic constraints, in numpy.

Fitting takes a bounded sample on the driver; a fitted model is five flat node
arrays, so scoring walks all rows of a batch down each tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class TreeArrays:
    """Nodes of all trees; a leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: float = 1.0) -> TreeArrays | None:
    """Newton boosting of the logistic loss; ``signs`` has +1, -1 or 0 for each feature.

    None if there are no rows or only one class.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots = []

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + least), low, high))

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, at, at, rate * leaf_value(g, h, low, high)])
        if level == depth or len(rows) < 10:
            return at
        best = (1e-6, -1, -1, 0.0, 0.0)
        whole = g * g / (h + least)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            codes = binned[f, rows]
            gl = np.cumsum(np.bincount(codes, grad[rows], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes, hess[rows], len(edges) + 1))[:-1]
            gr, hr = g - gl, h - hl
            vl, vr = np.clip(-gl / (hl + least), low, high), np.clip(-gr / (hr + least), low, high)
            gain = gl * gl / (hl + least) + gr * gr / (hr + least) - whole
            gain[(signs[f] * (vr - vl) < 0) | (hl < 0.5) | (hr < 0.5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k, vl[k], vr[k])
        _, f, k, vl, vr = best
        if f < 0:
            return at
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(signs[f])]
        is_left = binned[f, rows] <= k
        left = grow(rows[is_left], grad, hess, level + 1, *bounds[0])
        right = grow(rows[~is_left], grad, hess, level + 1, *bounds[1])
        nodes[at][:4] = [f, cuts[f][k], left, right]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        margin = margin + _one_tree(nodes, first, depth, x)
    table = np.array(nodes)
    return TreeArrays(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots), depth, base)


def _one_tree(nodes: list[list[float]], root: int, depth: int, x: np.ndarray) -> np.ndarray:
    table = np.array(nodes[root:])
    at = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(depth):
        f = table[at, 0].astype(np.int64)
        step = np.where(x[rows, np.maximum(f, 0)] <= table[at, 1], table[at, 2], table[at, 3]).astype(np.int64) - root
        at = np.where(f < 0, at, step)
    return table[at, 4]
