"""Gradient-boosted trees for two classes in numpy, with monotonic constraints, as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf is a node whose `left` is 0.

    A row goes left from a node if its feature is at most the threshold; the right child follows
    the left one.
    """

    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    start: float = 0.0
    depth: int = 0

    def add(self) -> int:
        for column, empty in ((self.feature, 0), (self.threshold, 0.0), (self.left, 0), (self.value, 0.0)):
            column.append(empty)
        return len(self.left) - 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        feature, left = np.array(self.feature, np.int64), np.array(self.left, np.int64)
        threshold, value = np.array(self.threshold), np.array(self.value)
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                below = left[node]
                node = np.where(below > 0, below + (x[rows, feature[node]] > threshold[node]), node)
            total += value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scores(x), -500, 500)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    signs: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    least: float = 5.0,
    penalty: float = 1.0,
) -> Trees:
    """Trees on the log loss. signs[j] is 1 or -1 where the score must not fall or rise with feature j, else 0.

    A split on such a feature needs children in that order, and the halfway value between them
    bounds all that grows below, so whole trees keep the order. One class only, or no rows, gives
    a constant score.
    """
    model = Trees(depth=depth)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.start = float(np.log(share / (1 - share)))
    if len(y) < 2 * least or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), model.start)

    def grow(node: int, rows: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = grad[rows], hess[rows]
        model.value[node] = rate * float(np.clip(-g.sum() / (h.sum() + penalty), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if len(c) == 0:
                    continue
                size = len(c) + 1
                gs, hs, ns = (np.bincount(binned[rows, j], w, size).cumsum() for w in (g, h, None))
                gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                gr, hr, nr = gs[-1] - gl, hs[-1] - hl, ns[-1] - nl
                vl, vr = (np.clip(-a / (b + penalty), low, high) for a, b in ((gl, hl), (gr, hr)))
                gain = -(gl * vl + (hl + penalty) * vl**2 / 2) - (gr * vr + (hr + penalty) * vr**2 / 2)
                whole = np.clip(-gs[-1] / (hs[-1] + penalty), low, high)
                gain += gs[-1] * whole + (hs[-1] + penalty) * whole**2 / 2
                gain[(nl < least) | (nr < least) | (signs[j] * (vr - vl) < 0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, vl[k], vr[k]))
        if best[1] is None:
            score[rows] += model.value[node]
            return
        j, k, vl, vr = best[1]
        model.feature[node], model.threshold[node] = j, float(cuts[j][k])
        model.left[node] = model.add()
        model.add()
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs[j], ((low, high),) * 2)
        goes = binned[rows, j] > k
        for side, (part, bound) in enumerate(zip((rows[~goes], rows[goes]), bounds, strict=True)):
            grow(model.left[node] + side, part, level + 1, *bound)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        model.roots.append(model.add())
        grow(model.roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)
    return model
