"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """All trees as node arrays.  A leaf points at itself, so that walking ``depth`` steps always ends in a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves of all trees for every row of ``x``: one gather per level for all rows and trees."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 10) -> FlatTrees:
    """Boosted trees for labels 0/1.  ``monotone[f]`` is +1 or -1 where the score must not fall or rise with f, else 0.

    A split on a constrained feature must order its children's values, and its middle then bounds everything below
    either child; so the whole tree, not only the split, is monotonic in that feature.
    """
    n, n_features = x.shape
    prior = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for f in range(n_features)]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(n_features)], axis=1) if n else np.zeros((0, n_features), int)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    score = np.full(n, base)

    def add() -> int:
        k = len(nodes["feature"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", 0.0)):
            nodes[name].append(v)
        return k

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        k = add()
        total_g, total_h = grad[rows].sum(), hess[rows].sum()
        value = float(np.clip(-total_g / (total_h + l2), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * min_rows:
            for f in range(n_features):
                width = len(edges[f]) + 1
                if width < 2:
                    continue
                c = codes[rows, f]
                g, h, m = (np.cumsum(np.bincount(c, w, minlength=width))[:-1] for w in (grad[rows], hess[rows], None))
                vl, vr = -g / (h + l2), -(total_g - g) / (total_h - h + l2)
                vl, vr = np.clip(vl, low, high), np.clip(vr, low, high)
                part = lambda gg, hh, v: -(gg * v + 0.5 * (hh + l2) * v * v)
                gain = part(g, h, vl) + part(total_g - g, total_h - h, vr) - part(total_g, total_h, value)
                allowed = (m >= min_rows) & (len(rows) - m >= min_rows)
                if monotone[f]:
                    allowed &= (vr - vl) * monotone[f] >= 0
                gain = np.where(allowed, gain, -np.inf)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), (f, at, float(vl[at]), float(vr[at])))
        if best[1] is None:
            nodes["value"][k] = rate * value
            score[rows] += rate * value
            return k
        f, at, vl, vr = best[1]
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
        goes_left = codes[rows, f] <= at
        nodes["feature"][k], nodes["threshold"][k] = f, edges[f][at]
        nodes["left"][k] = grow(rows[goes_left], grad, hess, level + 1, *bounds[0])
        nodes["right"][k] = grow(rows[~goes_left], grad, hess, level + 1, *bounds[1])
        return k

    for _ in range(n_trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    kinds = {"feature": np.int32, "threshold": float, "left": np.int32, "right": np.int32, "value": float}
    return FlatTrees(**{k: np.array(v, dtype=kinds[k]) for k, v in nodes.items()}, roots=np.array(roots, dtype=np.int32), depth=depth, base=base)
