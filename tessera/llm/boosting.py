"""A small gradient-boosted tree classifier in numpy, whose trees also read as SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Leaf:
    """What a leaf adds to the margin."""

    value: float


@dataclass
class Split:
    """Rows with feature <= at go left."""

    feature: int
    at: float
    left: Split | Leaf
    right: Split | Leaf


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Booster:
    """Logistic boosting with Newton leaves."""

    rounds: int = 24
    depth: int = 3
    rate: float = 0.3
    penalty: float = 1.0
    start: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        """Fit to rows x and labels y of 0 and 1; ties between splits go to the first feature and least cut."""
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start, self.trees = float(np.log(mean / (1 - mean))), []
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = _sigmoid(margin)
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Split | Leaf:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if depth else ():
            v = x[rows, f]
            for cut in np.unique(v)[:-1]:
                left = v <= cut
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                if gain > best[0] + 1e-12:
                    best = (gain, f, float(cut))
        if best[1] is None:
            return Leaf(float(-self.rate * gs / (hs + self.penalty)))
        left = x[rows, best[1]] <= best[2]
        return Split(best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _walk(self, node: Split | Leaf, x: np.ndarray) -> np.ndarray:
        if isinstance(node, Leaf):
            return np.full(len(x), node.value)
        return np.where(x[:, node.feature] <= node.at, self._walk(node.left, x), self._walk(node.right, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of rows x."""
        return self.start + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self, features: str) -> str:
        """The log odds as SQL over an array of the features."""

        def read(node: Split | Leaf) -> str:
            return f"{node.value!r}D" if isinstance(node, Leaf) else f"CASE WHEN {features}[{node.feature}] <= {node.at!r}D THEN {read(node.left)} ELSE {read(node.right)} END"

        return " + ".join([f"{self.start!r}D", *map(read, self.trees)])


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which the rows selected have that precision; 1.1 (select nothing) where none has."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True)  # ties stay together
    good = np.flatnonzero((hit >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 1.1


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset that calibrate margins z to labels y (Newton steps on the smoothed labels)."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([z, np.ones_like(z)], 1)
    for _ in range(rounds):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-6 * np.eye(2), a.T @ (p - t))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
