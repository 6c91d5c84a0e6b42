"""A small gradient-boosted classifier: trees of depth two on binned features, logistic loss."""

from __future__ import annotations

import numpy as np

BINS = 16


class Boosted:
    """Boosted depth-two trees; features are small non-negative integers, larger ones count as `BINS` - 1."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, least: float = 4.0, ridge: float = 1.0):
        self.rounds, self.rate, self.least, self.ridge = rounds, rate, least, ridge
        self.base, self.trees = 0.0, []

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, where = 1e-6, None
        for f in range(x.shape[1]):
            gs, hs = np.bincount(x[:, f], g, BINS).cumsum(), np.bincount(x[:, f], h, BINS).cumsum()
            for t in range(BINS - 1):
                hl, hr = hs[t], hs[-1] - hs[t]
                if hl < self.least or hr < self.least:
                    continue
                gl, gr = gs[t], gs[-1] - gs[t]
                gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - gs[-1] ** 2 / (hs[-1] + self.ridge)
                if gain > best:
                    best, where = gain, (f, t)
        return where

    def _leaf(self, g: np.ndarray, h: np.ndarray) -> float:
        return float(-self.rate * g.sum() / (h.sum() + self.ridge))

    def fit(self, x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> Boosted:
        """Learns the classes `y` of the rows `x`; each row counts as often as `times` says."""
        x = np.minimum(x, BINS - 1).astype(np.int64)
        times = np.ones(len(y)) if times is None else times.astype(np.float64)
        rate = np.clip((times * y).sum() / times.sum() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = times * (p - y), times * p * (1 - p)
            root = self._split(x, g, h)
            if root is None:
                break
            tree: list = [root]
            left = x[:, root[0]] <= root[1]
            for side in (left, ~left):
                split = self._split(x[side], g[side], h[side])
                if split is None:
                    leaf = self._leaf(g[side], h[side])
                    tree.append((0, BINS, leaf, leaf))
                else:
                    low = x[side][:, split[0]] <= split[1]
                    tree.append((*split, self._leaf(g[side][low], h[side][low]), self._leaf(g[side][~low], h[side][~low])))
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    @staticmethod
    def _tree(tree: list, x: np.ndarray) -> np.ndarray:
        (f, t), *sides = tree
        value = [np.where(x[:, f2] <= t2, a, b) for f2, t2, a, b in sides]
        return np.where(x[:, f] <= t, value[0], value[1])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        x = np.minimum(x, BINS - 1).astype(np.int64)
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._tree(tree, x)
        return 1 / (1 + np.exp(-score))
