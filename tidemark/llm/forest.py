"""A small random forest: numbers in, probability of the second class out."""

from __future__ import annotations

import numpy as np


class Tree:
    """Nodes as arrays: feature (-1 in leaves), threshold, left, right, share of the second class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
        self.nodes: list[list[float]] = []
        self._grow(x, y, rng, depth, least)
        table = np.array(self.nodes)
        self.feature, self.threshold, self.left, self.right, self.share = table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def _grow(self, x, y, rng, depth, least) -> int:
        own = len(self.nodes)
        self.nodes.append([-1, 0, own, own, float(y.mean())])
        if depth and len(y) >= 2 * least and 0 < y.sum() < len(y):
            best = None
            for f in rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5))]:
                order = np.argsort(x[:, f], kind="stable")
                v, ones, n = x[order, f], np.cumsum(y[order])[:-1], np.arange(1, len(y))
                cut = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
                if not cut.any():
                    continue
                a, b = ones / n, (y.sum() - ones) / (len(y) - n)
                impurity = np.where(cut, n * a * (1 - a) + (len(y) - n) * b * (1 - b), np.inf)
                k = int(impurity.argmin())
                if best is None or impurity[k] < best[0]:
                    best = impurity[k], f, v[k]  # a value that occurs: a midpoint of near neighbours may round up to the upper one
            if best is not None:
                side = x[:, best[1]] <= best[2]
                left = self._grow(x[side], y[side], rng, depth - 1, least)
                right = self._grow(x[~side], y[~side], rng, depth - 1, least)
                self.nodes[own][:4] = [best[1], best[2], left, right]
        return own

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        while (moving := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            down = np.where(x[np.arange(len(x)), f] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(moving, down, at)
        return self.share[at]


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 2, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(x[rows], y[rows], rng, depth, least))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)
