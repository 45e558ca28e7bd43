"""Small regression trees on binned columns, boosted by second-order logistic gradients; numpy only, on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Node i splits on column[i] <= cut[i], or is a leaf where column[i] is -1."""

    column: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for part, x in zip((self.column, self.cut, self.left, self.right, self.value), (-1, 0.0, -1, -1, value), strict=True):
            part.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.column[node] < 0:
                out[rows] = self.value[node]
                continue
            low = x[rows, self.column[node]] <= self.cut[node]
            stack += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conjunctions that lead to every node but the root: (column, at most?, cut)."""
        out, stack = [], [(0, ())]
        while stack:
            node, path = stack.pop()
            if path:
                out.append(path)
            if self.column[node] >= 0:
                c, t = self.column[node], self.cut[node]
                stack += [(self.left[node], (*path, (c, True, t))), (self.right[node], (*path, (c, False, t)))]
        return out


def bin_columns(x: np.ndarray, bins: int = 48) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes and, for each column, the cuts between them: midpoints of quantiles."""
    codes, cuts = np.zeros(x.shape, np.int64), []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)))
        edges = (q[1:] + q[:-1]) / 2
        cuts.append(edges)
        codes[:, j] = np.searchsorted(edges, x[:, j], "left")
    return codes, cuts


def fit_tree(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float = 5.0, ridge: float = 1.0, rows: np.ndarray | None = None) -> Tree:
    """One tree that lowers the quadratic model of the loss; `least` is the smallest sum of hess in a leaf."""
    tree = Tree()
    rows = np.arange(len(codes)) if rows is None else rows
    leaf = lambda r: float(-grad[r].sum() / (hess[r].sum() + ridge))
    stack = [(tree.add(leaf(rows)), rows, depth)]
    while stack:
        node, own, left_depth = stack.pop()
        g, h = grad[own], hess[own]
        total_g, total_h = g.sum(), h.sum()
        best = (1e-6, -1, -1)
        for j, edges in enumerate(cuts if left_depth else []):
            if len(edges) < 1:
                continue
            gl = np.cumsum(np.bincount(codes[own, j], weights=g, minlength=len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[own, j], weights=h, minlength=len(edges) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
            gain[(hl < least) | (total_h - hl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] < 0:
            continue
        low = codes[own, best[1]] <= best[2]
        tree.column[node], tree.cut[node] = best[1], float(cuts[best[1]][best[2]])
        tree.left[node], tree.right[node] = tree.add(leaf(own[low])), tree.add(leaf(own[~low]))
        stack += [(tree.left[node], own[low], left_depth - 1), (tree.right[node], own[~low], left_depth - 1)]
    return tree


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, share: float = 1.0, seed: int = 5) -> Boosted:
    """Logistic boosting; with share < 1 each tree sees that part of the rows."""
    rng = np.random.default_rng(seed)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(mean / (1 - mean))), rate, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    codes, cuts = bin_columns(x)
    z = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = None if share >= 1 else np.flatnonzero(rng.random(len(y)) < share)
        tree = fit_tree(codes, cuts, p - y, p * (1 - p), depth, rows=rows)
        model.trees.append(tree)
        z += rate * tree.predict(x)
    return model
