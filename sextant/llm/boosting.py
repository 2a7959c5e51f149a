"""Gradient-boosted trees for yes or no, in numpy, for models fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Depth-limited regression trees on the logit; node arrays of all trees have the same length."""

    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    depth: int = 3

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50, l2: float = 1e-2) -> tuple[float, float]:
    """Slope and shift that calibrate logits ``z`` to labels ``y`` (Newton steps; targets are drawn in by one label each)."""
    ones = y.sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([np.clip(z, -30, 30), np.ones(len(z))], axis=1)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - t) + l2 * (w - np.array([1.0, 0.0]))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([l2 + 1e-6, l2 + 1e-6])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 24, l2: float = 1.0) -> Trees:
    """Newton boosting on quantile bins. With no rows, or one class only, the answer is a steadied constant."""
    p0 = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Trees(start=float(np.log(p0 / (1 - p0))), depth=depth)
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    logit = np.full(len(y), model.start)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                best = (1e-3, 0, 0)
                if len(at) > 3:
                    gs, hs = g[at].sum(), h[at].sum()
                    for f, e in enumerate(edges):
                        if len(e) == 0:
                            continue
                        gl = np.cumsum(np.bincount(binned[at, f], weights=g[at], minlength=len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[at, f], weights=h[at], minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (float(gain[j]), f, j)
                if best[0] > 1e-3:
                    feature[k], cut[k] = best[1], edges[best[1]][best[2]]
                node[at] = 2 * k + 1 + (x[at, feature[k]] > cut[k])
        leaf = node - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + l2)
        logit = logit + value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
    return model
