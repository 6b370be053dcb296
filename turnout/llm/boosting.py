"""Gradient-boosted trees and isotonic calibration in numpy, for a few dense features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: at each inner node, go right if the feature is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.value).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - len(self.feature)]


@dataclass(frozen=True)
class Boosted:
    trees: list[Tree]
    base: float
    steps: np.ndarray
    levels: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a thousandth of the raw score so that ties keep their order."""
        margin = self.margin(x)
        raw = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return 0.999 * np.interp(margin, self.steps, self.levels) + 0.001 * raw


def _best_split(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, least: int, ridge: float):
    best = (1e-9, 0, np.inf)
    total_g, total_h = gradient.sum(), hessian.sum()
    for f in range(x.shape[1]):
        order = x[:, f].argsort(kind="stable")
        value = x[order, f]
        g, h = gradient[order].cumsum()[:-1], hessian[order].cumsum()[:-1]
        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
        n = np.arange(1, len(value))
        gain[(value[1:] == value[:-1]) | (n < least) | (n > len(value) - least)] = -np.inf
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            best = (float(gain[k]), f, float((value[k] + value[k + 1]) / 2))
    return best


def _grow(x, gradient, hessian, depth: int, rate: float, least: int, ridge: float) -> Tree:
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    value = np.zeros(inner + 1)
    members = {0: np.arange(len(x))}
    for node in range(inner):
        rows = members.pop(node)
        if len(rows) >= 2 * least:
            _, feature[node], threshold[node] = _best_split(x[rows], gradient[rows], hessian[rows], least, ridge)
        right = x[rows, feature[node]] > threshold[node]
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    for leaf, rows in members.items():
        value[leaf - inner] = rate * gradient[rows].sum() / (hessian[rows].sum() + ridge)
    return Tree(feature, threshold, value)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps and rising levels that fit the labels best, by pooling adjacent violators."""
    names, place = np.unique(score, return_inverse=True)
    weight = np.bincount(place).astype(float)
    mean = np.bincount(place, label) / weight
    pools: list[list[float]] = []
    for step, m, w in zip(names, mean, weight):
        pools.append([m, w, step, step])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m1, w1, low, _ = pools[-2]
            m2, w2, _, high = pools.pop()
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, low, high]
    steps = np.array([s for p in pools for s in (p[2], p[3])])
    return steps, np.array([p[0] for p in pools for _ in range(2)])


def fit(
    x: np.ndarray,
    label: np.ndarray,
    calibration: np.ndarray,
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    least: int = 5,
    ridge: float = 1.0,
) -> Boosted:
    """Trees on the rows outside ``calibration``, isotonic levels on the rows in it."""
    learn = ~calibration if (~calibration).any() else np.ones(len(x), bool)
    xs, y = x[learn], label[learn].astype(float)
    rate_of_one = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    margin = np.full(len(xs), base)
    trees = []
    for _ in range(n_trees if len(xs) else 0):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(xs, y - p, p * (1 - p), depth, rate, least, ridge))
        margin += trees[-1].predict(xs)
    model = Boosted(trees, base, np.zeros(1), np.full(1, rate_of_one))
    fold = calibration if calibration.any() and len(set(label[calibration])) > 1 else np.ones(len(x), bool)
    if not fold.any():
        return model
    steps, levels = isotonic(model.margin(x[fold]), label[fold].astype(float))
    return Boosted(trees, base, steps, levels)
