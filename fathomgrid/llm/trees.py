"""Decision trees and boosted trees in numpy, for the small labelled tables of this subpackage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[node]
            at = node[inner]
            node[inner] = np.where(x[inner, f[inner]] <= self.cut[at], self.left[at], self.right[at])


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 4, ridge: float = 1e-9, bins: int = 64) -> Tree:
    """Greedy tree of Newton steps: a leaf's value is sum(g) / (sum(h) + ridge). With g = y and h = 1 it is a class's share."""
    n, m = x.shape
    cuts, code = [], np.empty((n, m), np.int64)
    for j in range(m):
        u = np.unique(x[:, j])
        u = u if len(u) <= bins else np.unique(np.quantile(u, np.linspace(0, 1, bins)))
        mid = (u[1:] + u[:-1]) / 2
        cuts.append(mid)
        code[:, j] = np.searchsorted(mid, x[:, j], side="left") + j * bins
    out: list[list[float]] = []

    def node(rows: np.ndarray, d: int) -> int:
        me = len(out)
        sg, sh = g[rows].sum(), h[rows].sum()
        out.append([-1, 0.0, -1, -1, sg / (sh + ridge)])
        if d == 0 or len(rows) < 2 * least:
            return me
        flat = code[rows].ravel()
        hist = [np.bincount(flat, w, m * bins).reshape(m, bins).cumsum(1) for w in (np.repeat(g[rows], m), np.repeat(h[rows], m), None)]
        lg, lh, ln = hist
        gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
        gain[(ln < least) | (len(rows) - ln < least)] = -1
        j, b = divmod(int(gain.argmax()), bins)
        if gain[j, b] <= 1e-9:
            return me
        goes = code[rows, j] - j * bins <= b
        out[me][:2] = [j, cuts[j][b]]
        out[me][2] = node(rows[goes], d - 1)
        out[me][3] = node(rows[~goes], d - 1)
        return me

    node(np.arange(n), depth)
    a = np.array(out, float)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t(x)
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Gradient boosting of the logistic loss."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), rate, [])
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        t = grow(x, y - p, np.maximum(p * (1 - p), 1e-6), depth, ridge=ridge)
        model.trees.append(t)
        z += rate * t(x)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, probabilities), both ascending, for np.interp."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order].astype(float)):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, _, hi = blocks.pop()
            v1, n1, lo, _ = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi])
    xs = np.array([b[i] for b in blocks for i in (2, 3)])
    ys = np.array([b[0] for b in blocks for _ in (0, 1)])
    return xs, ys
