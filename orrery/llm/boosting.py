"""Histogram gradient-boosted trees for a binary label, in numpy; trained on a bounded table, flattened for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes end to end. A leaf points to itself, so a fixed number of steps reaches it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of x, by simultaneous descent of all trees."""
        out = np.empty(len(x))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            at = np.repeat(self.roots[None, :], len(part), 0)
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[lo : lo + 4096] = 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: int = 10) -> Forest:
    """Second-order boosting of the logistic loss. Level-wise growth; per node and feature one histogram of gradients."""
    n, d = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], 1) if n else np.zeros((0, d), int)
    margin = np.full(n, base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        level = {len(nodes) - 1: np.arange(n)}
        for step in range(depth + 1):
            following = {}
            for node, rows in level.items():
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                if step < depth and len(rows) >= 2 * least:
                    flat = (binned[rows] + np.arange(d) * bins).ravel()
                    hg = np.bincount(flat, np.repeat(g[rows], d), d * bins).reshape(d, bins)
                    hh = np.bincount(flat, np.repeat(h[rows], d), d * bins).reshape(d, bins)
                    hn = np.bincount(flat, minlength=d * bins).reshape(d, bins)
                    lg, lh, ln = hg.cumsum(1), hh.cumsum(1), hn.cumsum(1)
                    gain = lg**2 / (lh + smooth) + (gs - lg) ** 2 / (hs - lh + smooth) - gs**2 / (hs + smooth)
                    gain[(ln < least) | (len(rows) - ln < least)] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > best[0] and b < len(cuts[j]):
                        best = (gain[j, b], (int(j), int(b)))
                if best[1] is None:
                    value = -rate * gs / (hs + smooth)
                    nodes[node] = [0, np.inf, node, node, value]
                    margin[rows] += value
                    continue
                j, b = best[1]
                low = binned[rows, j] <= b
                nodes[node] = [j, float(cuts[j][b]), len(nodes), len(nodes) + 1, 0.0]
                following[len(nodes)], following[len(nodes) + 1] = rows[low], rows[~low]
                nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
            level = following
    if not roots:
        roots, nodes = [0], [[0, np.inf, 0, 0, 0.0]]
    f, t, a, b, v = (np.array(c) for c in zip(*nodes))
    return Forest(f.astype(np.int32), t.astype(float), a.astype(np.int32), b.astype(np.int32), v.astype(float), np.array(roots, np.int32), depth, base)
