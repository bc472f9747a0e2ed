"""Gradient boosted trees over small whole-number features, fitted from counted rows.

Spark counts how often each combination of features and label occurs; the combinations, bounded
by the feature grid, are all the fit needs. A fitted model is a column expression, so it runs
where the rows are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TREES = 24
RATE = 0.3
SHRINK = 4.0


@dataclass(frozen=True)
class Tree:
    """Left if ``features[feature] <= cut``; a child is a value or another tree."""
    feature: int
    cut: int
    left: Tree | float
    right: Tree | float


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-g.sum() / (h.sum() + SHRINK))


def _gain(g: float, h: float) -> float:
    return g * g / (h + SHRINK)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree | float:
    best = (1e-6, None, None)
    whole = _gain(g.sum(), h.sum())
    for feature in range(x.shape[1]):
        for cut in np.unique(x[:, feature])[:-1]:
            low = x[:, feature] <= cut
            gain = _gain(g[low].sum(), h[low].sum()) + _gain(g[~low].sum(), h[~low].sum()) - whole
            if gain > best[0]:
                best = (gain, feature, int(cut))
    if not depth or best[1] is None:
        return _leaf(g, h)
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], _grow(x[low], g[low], h[low], depth - 1),
                _grow(x[~low], g[~low], h[~low], depth - 1))


def _predict(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Tree):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.cut, _predict(tree.left, x), _predict(tree.right, x))


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree | float, ...]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.start + RATE * sum((_predict(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """Score between 0 and 1 as one expression."""
        def of(tree):
            if not isinstance(tree, Tree):
                return F.lit(float(tree))
            return F.when(features[tree.feature] <= tree.cut, of(tree.left)).otherwise(of(tree.right))
        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + F.lit(RATE) * of(tree)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, positive: np.ndarray, n: np.ndarray, depth: int = 2, trees: int = TREES) -> Model:
    """Logistic boosting; row ``i`` stands for ``n[i]`` rows of which ``positive[i]`` are positive."""
    share = (positive.sum() + 0.5) / (n.sum() + 1)
    start, grown = math.log(share / (1 - share)), []
    logits = np.full(len(x), start)
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-logits))
        tree = _grow(x, n * p - positive, n * p * (1 - p), depth)
        grown.append(tree)
        logits = logits + RATE * _predict(tree, x)
    return Model(start, tuple(grown))


def threshold(score: np.ndarray, positive: np.ndarray, n: np.ndarray, precision: float) -> float:
    """The lowest score from which on the share of positives is at least ``precision``; 2.0 if none."""
    order = np.argsort(-score, kind="stable")
    s, hit, all_ = score[order], np.cumsum(positive[order]), np.cumsum(n[order])
    last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, dtype=bool)   # ties go together
    ok = np.flatnonzero(last & (hit >= precision * all_) & (all_ > 0))
    return float(s[ok[-1]]) if len(ok) else 2.0
