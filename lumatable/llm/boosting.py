"""Gradient-boosted trees on few binned features: logistic loss, exact greedy splits, no dependencies beyond numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, LEAF_ROWS, RIDGE, BINS = 60, 3, 0.25, 5, 1.0, 16


class BoostedTrees:
    """Binary classifier. `edges` bin each feature; a tree is an array of (feature, bin, left, right) with leaf values."""

    def __init__(self) -> None:
        self.bias, self.trees, self.edges = 0.0, [], []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]).astype(np.int16) if len(self.edges) else np.zeros((len(x), 0), np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(np.unique(x[:, k])) > BINS else np.unique(x[:, k])[1:] for k in range(x.shape[1])]
        b = self._bin(x)
        share = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
            tree: list = []
            self._grow(b, grad, hess, np.arange(len(y)), DEPTH, tree)
            self.trees.append(tree)
            score += self._apply(tree, b)
        return self

    def _grow(self, b, grad, hess, rows, depth, tree) -> int:
        me, g, h = len(tree), grad[rows].sum(), hess[rows].sum()
        tree.append(RATE * g / (h + RIDGE))
        if depth == 0 or len(rows) < 2 * LEAF_ROWS:
            return me
        best, gain0 = None, g * g / (h + RIDGE)
        for k in range(b.shape[1]):
            col, n = b[rows, k], len(self.edges[k]) + 1
            if n < 2:
                continue
            gs, hs, cs = (np.cumsum(np.bincount(col, v, n))[:-1] for v in (grad[rows], hess[rows], None))
            gain = np.where((cs >= LEAF_ROWS) & (len(rows) - cs >= LEAF_ROWS), gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - gain0, -np.inf)
            at = int(gain.argmax())
            if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                best = (gain[at], k, at)
        if best:
            _, k, at = best
            left = b[rows, k] <= at
            tree[me] = (k, at, self._grow(b, grad, hess, rows[left], depth - 1, tree), self._grow(b, grad, hess, rows[~left], depth - 1, tree))
        return me

    @staticmethod
    def _apply(tree: list, b: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(b)), [(0, np.arange(len(b)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(tree[node], tuple):
                k, at, left, right = tree[node]
                go = b[rows, k] <= at
                stack += [(left, rows[go]), (right, rows[~go])]
            else:
                out[rows] = tree[node]
        return out

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All trees as full ones of the same depth: features and bins by node, values by leaf."""
        inner = 2**DEPTH - 1
        feature, edge, leaf = np.zeros((len(self.trees), inner), np.int64), np.full((len(self.trees), inner), BINS + 1, np.int16), np.zeros((len(self.trees), inner + 1))
        for t, tree in enumerate(self.trees):
            stack = [(0, 0)]
            while stack:
                node, at = stack.pop()
                if at >= inner:
                    leaf[t, at - inner] = tree[node]
                elif isinstance(tree[node], tuple):
                    feature[t, at], edge[t, at] = tree[node][:2]
                    stack += [(tree[node][2], 2 * at + 1), (tree[node][3], 2 * at + 2)]
                else:
                    stack.append((node, 2 * at + 1))  # an early leaf: every row goes left
        return feature, edge, leaf

    def state(self) -> dict:
        """The fitted trees as plain lists and numbers."""
        return {"bias": self.bias, "trees": self.trees, "edges": [e.tolist() for e in self.edges]}

    @classmethod
    def of(cls, state: dict) -> BoostedTrees:
        out = cls()
        out.bias, out.edges = state["bias"], [np.array(e, dtype=float) for e in state["edges"]]
        out.trees = [[tuple(n) if isinstance(n, list) else n for n in tree] for tree in state["trees"]]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        if not len(x):
            return np.zeros(0)
        if not hasattr(self, "flat"):
            self.flat = self._flat()
        feature, edge, leaf = self.flat
        b, rows, trees = self._bin(x), np.arange(len(x))[:, None], np.arange(len(self.trees))[None, :]
        at = np.zeros((len(x), len(self.trees)), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (b[rows, feature[trees, at]] > edge[trees, at])
        return self.bias + leaf[trees, at - leaf.shape[1] + 1].sum(axis=1)


@dataclass(frozen=True)
class Platt:
    """Calibration of log-odds: the logistic curve over them that fits rows the trees have not seen."""

    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, margin: np.ndarray, y: np.ndarray) -> Platt:
        """By Newton's steps, with the targets drawn in a little, as few rows must not give certainty; unchanged where one class is missing."""
        if not len(y) or y.min() == y.max():
            return cls()
        n1, n0 = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        x, w = np.column_stack([margin, np.ones(len(y))]), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - target)
            step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), grad)
            w = w - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        return cls(float(max(w[0], 0.05)), float(w[1]))

    def apply(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

    def state(self) -> list[float]:
        return [self.slope, self.shift]
