"""A small random forest for two classes, in NumPy, for models that are trained on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Each tree: arrays feature (-1: leaf), threshold, left, right, value."""

    trees: tuple[tuple[np.ndarray, ...], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of class 1, as the trees' mean."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += value[at]
        return total / len(self.trees)


def _best_split(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """(Gini impurity, threshold) of the best cut of one feature."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    cut = np.flatnonzero(x[1:] > x[:-1]) + 1
    if not len(cut):
        return None
    ones, n = np.cumsum(y), len(y)
    a = ones[cut - 1] / cut
    b = (ones[-1] - ones[cut - 1]) / (n - cut)
    gini = (cut * a * (1 - a) + (n - cut) * b * (1 - b)) / n
    best = int(np.argmin(gini))
    return float(gini[best]), float((x[cut[best] - 1] + x[cut[best]]) / 2)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value = [], [], [], [], []
    tries = max(1, int(np.sqrt(x.shape[1]) + 1))

    def node(rows: np.ndarray, left_depth: int) -> int:
        at = len(feature)
        for column, what in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, float(y[rows].mean()))):
            column.append(what)
        if left_depth == 0 or len(rows) < 2 * leaf or value[at] in (0.0, 1.0):
            return at
        best = None
        for f in rng.choice(x.shape[1], tries, replace=False):
            got = _best_split(x[rows, f], y[rows])
            if got and (best is None or got[0] < best[0]):
                best = (*got, int(f))
        if best is None:
            return at
        goes = x[rows, best[2]] <= best[1]
        feature[at], threshold[at] = best[2], best[1]
        left[at] = node(rows[goes], left_depth - 1)
        right[at] = node(rows[~goes], left_depth - 1)
        return at

    node(np.arange(len(y)), depth)
    return tuple(map(np.array, (feature, threshold, left, right, value)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, leaf: int = 2, seed: int = 0) -> Forest:
    """Bootstrap samples of the rows, and at each node a random choice of about sqrt features."""
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        grown.append(_grow(x[rows], y[rows].astype(float), rng, depth, leaf))
    return Forest(tuple(grown))
