"""Gradient-boosted trees for two classes, on histograms, in numpy.

They are fitted on the driver to a bounded sample; scoring is done where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """A split (value <= cut goes left) or, without one, a leaf."""

    value: float = 0.0
    column: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    """bias + sum of the trees' leaves = log odds of class 1."""

    bias: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            _add(tree, x, np.arange(len(x)), out)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _add(node: Node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if node.left is None or node.right is None:
        out[rows] += node.value
    elif len(rows):
        low = x[rows, node.column] <= node.cut
        _add(node.left, x, rows[low], out)
        _add(node.right, x, rows[~low], out)


def _grow(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Node:
    g, h = grad[rows].sum(), hess[rows].sum()
    node = Node(value=float(rate * g / (h + ridge)))
    if depth == 0 or len(rows) < 2 * least:
        return node
    best = (1e-6, -1, 0)
    for c, edges in enumerate(cuts):
        if not len(edges):
            continue
        code = codes[rows, c]
        n = np.cumsum(np.bincount(code, minlength=len(edges) + 1))[:-1]
        gl = np.cumsum(np.bincount(code, grad[rows], len(edges) + 1))[:-1]
        hl = np.cumsum(np.bincount(code, hess[rows], len(edges) + 1))[:-1]
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
        gain[(n < least) | (len(rows) - n < least)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), c, at)
    _, c, at = best
    if c < 0:
        return node
    low = codes[rows, c] <= at
    node.column, node.cut = c, float(cuts[c][at])
    node.left = _grow(codes, cuts, grad, hess, rows[low], depth - 1, least, ridge, rate)
    node.right = _grow(codes, cuts, grad, hess, rows[~low], depth - 1, least, ridge, rate)
    return node


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 5, ridge: float = 1.0, share: float = 1.0, seed: int = 1) -> Boosted:
    """Fit to rows x and classes y (0 or 1). No rows, or one class, give a constant.

    Each tree sees a random share of the columns, so that one which tells the classes apart
    on its own doesn't keep the others out. The same rows in any order give the same trees
    up to rounding; callers sort them.
    """
    if not len(y):
        return Boosted()
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        return model
    cuts = []
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(middles if len(middles) <= bins else np.unique(np.quantile(middles, np.linspace(0, 1, bins))))
    codes = np.stack([np.searchsorted(cuts[c], x[:, c], side="left") for c in range(x.shape[1])], axis=1)
    margin = np.full(len(y), model.bias)
    rows = np.arange(len(y))
    rng, none = np.random.default_rng(seed), np.zeros(0)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        seen = set(rng.permutation(len(cuts))[: max(1, round(share * len(cuts)))].tolist())
        tree = _grow(codes, [e if c in seen else none for c, e in enumerate(cuts)], y - p, p * (1 - p), rows, depth, least, ridge, rate)
        model.trees.append(tree)
        _add(tree, x, rows, margin)
    return model


def paths(node: Node, so_far: tuple[tuple[int, bool, float], ...] = ()) -> list[tuple[tuple[int, bool, float], ...]]:
    """Every path from the root to another node, as tests (column, at most, cut)."""
    out = [so_far] if so_far else []
    if node.left is not None and node.right is not None:
        out += paths(node.left, (*so_far, (node.column, True, node.cut)))
        out += paths(node.right, (*so_far, (node.column, False, node.cut)))
    return out
