"""A small random forest: Gini trees on bootstrap samples with a random choice of features a split."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as flat arrays, one row a tree: feature (-1 at a leaf), threshold, left child (right is next), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the share of positives in the leaf of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, t, l, v in zip(self.feature, self.threshold, self.left, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := f[at] >= 0).any():
                go = x[rows, np.maximum(f[at], 0)] > t[at]
                at = np.where(inner, l[at] + go, at)
            total += v[at]
        return total / len(self.feature)


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[int, float] | None:
    best, found = np.inf, None
    n = len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        left = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (left >= least) & (n - left >= least)
        if not ok.any():
            continue
        p, q = pos[:-1] / left, (pos[-1] - pos[:-1]) / (n - left)
        cost = np.where(ok, left * p * (1 - p) + (n - left) * q * (1 - q), np.inf)
        k = int(np.argmin(cost))
        if cost[k] < best - 1e-12:
            best, found = cost[k], (int(f), float((v[k] + v[k + 1]) / 2))
    return found


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 2, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    some = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    made = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        nodes = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0)]
        while todo:
            node, at, level = todo.pop()
            nodes[node][3] = float(y[at].mean())
            if level == depth or len(at) < 2 * least or nodes[node][3] in (0.0, 1.0):
                continue
            split = _best_split(x[at], y[at], rng.permutation(x.shape[1])[:some], least)
            if split is None:
                continue
            f, t = split
            nodes[node][:3] = [f, t, len(nodes)]
            right = x[at, f] > t
            for part in (at[~right], at[right]):
                todo.append((len(nodes), part, level + 1))
                nodes.append([-1, 0.0, 0, 0.0])
        made.append(nodes)
    most = max(map(len, made))
    pad = lambda k, kind: np.array([[n[k] for n in t] + [-1 if k == 0 else 0] * (most - len(t)) for t in made], kind)
    return Forest(pad(0, np.int64), pad(1, float), pad(2, np.int64), pad(3, float))
