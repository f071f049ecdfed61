"""Small decision trees on binned numeric statistics, grown in numpy on a bounded sample.

Two operators share them: the rule ensemble takes their paths as rules, the secret scanner
votes with a forest.  A tree is a list of nodes (feature, threshold, left, right, value); a
leaf has feature -1.  A row goes left where x[feature] <= threshold.
"""

from __future__ import annotations

import numpy as np

Node = tuple[int, float, int, int, float]
BINS = 32


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column the cut points between its quantiles."""
    cuts = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        top = col.max(initial=-np.inf)
        cuts.append(q[q < top])
    return cuts


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], axis=1) if x.shape[1] else np.zeros(x.shape, np.int64)


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator, features: int | None = None, least: float = 5.0, cuts: list[np.ndarray] | None = None) -> list[Node]:
    """A regression tree for `target` with row weights, by least squares (Gini for 0/1 targets)."""
    cuts = edges(x) if cuts is None else cuts
    b = _binned(x, cuts)
    nodes: list[list] = []

    def build(rows: np.ndarray, left_depth: int) -> int:
        w, t = weight[rows], target[rows]
        total, sums = w.sum(), (w * t).sum()
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(sums / total) if total else 0.0])
        if left_depth == 0 or total < 2 * least or np.ptp(t) == 0:
            return here
        best, at = 1e-9, None
        pool = np.arange(x.shape[1]) if features is None else rng.permutation(x.shape[1])[:features]
        for f in np.sort(pool):
            if not len(cuts[f]):
                continue
            k = len(cuts[f]) + 1
            wl = np.cumsum(np.bincount(b[rows, f], w, k))[:-1]
            sl = np.cumsum(np.bincount(b[rows, f], w * t, k))[:-1]
            ok = (wl >= least) & (total - wl >= least)
            if not ok.any():
                continue
            gain = np.where(ok, sl**2 / np.maximum(wl, 1e-12) + (sums - sl) ** 2 / np.maximum(total - wl, 1e-12) - sums**2 / total, -1)
            j = int(gain.argmax())
            if gain[j] > best:
                best, at = gain[j], (int(f), j)
        if at is None:
            return here
        f, j = at
        side = b[rows, f] <= j
        nodes[here][0], nodes[here][1] = f, float(cuts[f][j])
        nodes[here][2] = build(rows[side], left_depth - 1)
        nodes[here][3] = build(rows[~side], left_depth - 1)
        return here

    build(np.arange(len(x)), depth)
    return [tuple(n) for n in nodes]


def predict(tree: list[Node], x: np.ndarray) -> np.ndarray:
    """The leaf values of the rows."""
    f, t, l, r, v = (np.array(c) for c in zip(*tree))
    at = np.zeros(len(x), np.int64)
    while (inner := f[at] >= 0).any():
        rows = np.nonzero(inner)[0]
        n = at[rows]
        at[rows] = np.where(x[rows, f[n]] <= t[n], l[n], r[n])
    return v[at]


def paths(tree: list[Node]) -> list[tuple[tuple[int, bool, float], ...]]:
    """The conjunction (feature, is "<=", threshold) that leads to each node but the root."""
    out = []

    def walk(i: int, so_far: tuple) -> None:
        if so_far:
            out.append(so_far)
        f, t, l, r, _ = tree[i]
        if f >= 0:
            walk(l, (*so_far, (f, True, t)))
            walk(r, (*so_far, (f, False, t)))

    walk(0, ())
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, least: float = 2.0) -> list[list[Node]]:
    """A random forest: bootstrap rows as weights, a root of the features tried at each split per tree."""
    rng = np.random.default_rng(seed)
    cuts = edges(x)
    few = max(1, int(round(np.sqrt(x.shape[1]))) + 1)
    out = []
    for _ in range(trees):
        w = rng.multinomial(len(x), np.full(len(x), 1 / len(x))).astype(float)
        out.append(grow(x, y.astype(float), w, depth, rng, few, least, cuts))
    return out


def vote(trees: list[list[Node]], x: np.ndarray) -> np.ndarray:
    return np.mean([predict(t, x) for t in trees], axis=0) if len(x) else np.zeros(0)
