"""Growing and reading of trees over binned columns: what one task does for one fit whose distinct rows are within a checked size.

A row of ``x`` may stand for many equal ones: ``weight`` is how many, and ``y`` then how many of them are positive. Draws and samples
are of the rows that are stood for, so they have the distribution of draws from all of them.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

BINS = 32
#: Depth beyond which no tree is split.
DEEPEST = 30
#: The most trees that are grown side by side, and the most distinct rows of all of them.
SIDE_BY_SIDE, ROWS_AT_ONCE = 25, 1 << 16


def edges(column: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Cuts of a column's training values: between all of them if they are few, else at quantiles. With ``counts``, values are distinct and ascend."""
    own, counts = np.unique(column, return_counts=True) if counts is None else (column, counts)
    if len(own) <= BINS:
        return (own[:-1] + own[1:]) / 2
    upto = np.cumsum(counts)
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1)
    low, high = (own[np.searchsorted(upto, f(at), "right")] for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): the distinct rows of bins in order, and which of them each row is."""
    if not x.shape[1]:
        return x[:1], np.zeros(len(x), np.int64)
    one = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1]))).ravel()
    _, first, at = np.unique(one, return_index=True, return_inverse=True)
    return x[first], at


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


@dataclass
class Ensemble:
    """Trees one after the other: column (-1 at leaves), last bin that goes left, left child (the right one follows it), value."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @staticmethod
    def of(trees: list[tuple]) -> Ensemble:
        at = np.cumsum([0, *[len(t[0]) for t in trees]])
        join = lambda i: np.concatenate([t[i] for t in trees]) if trees else np.zeros(0)
        left = np.concatenate([t[2] + a for t, a in zip(trees, at)]) if trees else np.zeros(0)
        return Ensemble(join(0).astype(np.int16), join(1).astype(np.uint8), left.astype(np.int32), join(3).astype(float), at[:-1].astype(np.int32))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): values of the leaves that rows of bins reach."""
        rows = np.arange(len(x))[:, None]
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        while True:
            c = self.column[at]
            inner = c >= 0
            if not inner.any():
                return self.value[at]
            right = x[rows, np.maximum(c, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sums over trees, a few thousand rows at a time."""
        step = max(1, (1 << 20) // max(1, len(self.roots)))
        return np.concatenate([self.leaves(x[i : i + step]).sum(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, column=self.column, cut=self.cut, left=self.left, value=self.value, roots=self.roots)
        return out.getvalue()

    @staticmethod
    def unpacked(raw: bytes) -> Ensemble:
        with np.load(io.BytesIO(raw)) as z:
            return Ensemble(z["column"], z["cut"], z["left"], z["value"], z["roots"])


class _Nodes:
    def __init__(self):
        self.column, self.cut, self.left, self.value = [-1], [0], [0], [0.0]

    def split(self, node: int, column: int, cut: int) -> int:
        left = len(self.column)
        self.column[node], self.cut[node], self.left[node] = column, cut, left
        for of, v in ((self.column, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0)):
            of += [v, v]
        return left

    def done(self) -> tuple:
        return np.array(self.column), np.array(self.cut), np.array(self.left), np.array(self.value)


def forest_tree(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[tuple, np.ndarray]:
    """A tree of rows with weights; ``_grown`` says how it is grown."""
    return _grown(x, weight.astype(float), (weight * y).astype(float), rng)


def _grown(x: np.ndarray, weight: np.ndarray, positive: np.ndarray, rng: np.random.Generator) -> tuple[tuple, np.ndarray]:
    return _grown_together(x, [(weight, positive, rng)])[0]


def _grown_together(x: np.ndarray, draws: list[tuple]) -> list[tuple[tuple, np.ndarray]]:
    """(tree, importances) of each draw (weights, positives, generator): Gini splits among the square root of the columns, drawn for each node, until nodes are pure.

    A node that none of its drawn columns splits draws again among the others. Leaves hold the weighted share of positives. Trees are
    grown level by level side by side; each has draws of its own, so it is the same in any company.
    """
    columns = x.shape[1]
    few = max(1, int(np.sqrt(columns)))
    gain_of = np.zeros((len(draws), columns))
    trees = [_Nodes() for _ in draws]
    own = [np.flatnonzero(weight) for weight, _, _ in draws]
    rows, node = np.concatenate(own), np.repeat(np.arange(len(draws)), [len(r) for r in own])
    w, wy = (np.concatenate([d[i][r] for d, r in zip(draws, own)]) for i in (0, 1))
    names, of = np.zeros(len(draws), np.int64), np.arange(len(draws))  # numbers in their trees of the nodes of this level, and the trees
    for depth in range(DEEPEST + 1):
        n, p = np.bincount(node, w, len(names)), np.bincount(node, wy, len(names))
        for t, k, v in zip(of.tolist(), names.tolist(), (p / n).tolist()):
            trees[t].value[k] = v
        open_ = (p > 0) & (p < n)
        if depth == DEEPEST or not open_.any():
            break
        rows, node, w, wy = _among(open_, rows, node, w, wy)
        names, of, n, p = names[open_], of[open_], n[open_], p[open_]
        a = len(names)
        order = np.argsort(np.concatenate([d[2].random((k, columns)) for d, k in zip(draws, np.bincount(of, minlength=len(draws)))]), axis=1)
        best, column, cut = np.zeros(a), np.zeros(a, np.int64), np.zeros(a, np.int64)
        many = np.bincount(node, minlength=a) > 1  # a single row is not split
        for first in range(0, columns, few):
            stuck = many & (best <= 1e-12)
            if not stuck.any():
                break
            best[stuck], column[stuck], cut[stuck] = _best_gini(x, *_among(stuck, rows, node, w, wy), n[stuck], p[stuck], order[stuck, first : first + few])
        going = best > 1e-12
        if not going.any():
            break
        np.add.at(gain_of, (of[going], column[going]), best[going])
        fresh = []
        for t, k, c, at in zip(of[going].tolist(), names[going].tolist(), column[going].tolist(), cut[going].tolist()):
            left = trees[t].split(k, c, at)
            fresh += [left, left + 1]
        first_child = 2 * (np.cumsum(going) - 1)
        stay = going[node]
        rows, node, w, wy = rows[stay], node[stay], w[stay], wy[stay]
        node = first_child[node] + (x[rows, column[node]] > cut[node])
        names, of = np.array(fresh), np.repeat(of[going], 2)
    return [(tree.done(), g / g.sum() if g.sum() else g) for tree, g in zip(trees, gain_of)]


def _among(chosen: np.ndarray, rows, node, w, wy) -> tuple:
    """The rows of the chosen nodes, which are numbered anew."""
    number = np.cumsum(chosen) - 1
    own = chosen[node]
    return rows[own], number[node[own]], w[own], wy[own]


def _best_gini(x, rows, node, w, wy, n, p, drawn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, column and cut of each node's best split among its drawn columns; of equal ones the first drawn, then the least cut.

    Only bins that a node has rows in are looked at. Weights are whole numbers, so their sums are exact in any order.
    """
    a, few = drawn.shape
    key = ((node[:, None] * few + np.arange(few)) * BINS + x[rows[:, None], drawn[node]]).ravel()
    left, hit = (np.bincount(key, np.repeat(v, few), a * few * BINS) for v in (w, wy))
    at = np.flatnonzero(left)
    left, hit = left[at].cumsum(), hit[at].cumsum()
    place = at // BINS  # of the node and its drawn column
    first = np.flatnonzero(np.diff(place, prepend=-1))  # each has a row, so there are a * few
    size = np.diff(first, append=len(at))
    left -= np.repeat(np.concatenate(([0.0], left[first[1:] - 1])), size)
    hit -= np.repeat(np.concatenate(([0.0], hit[first[1:] - 1])), size)
    own = place // few
    right, miss = n[own] - left, p[own] - hit
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (hit**2 + (left - hit) ** 2) / left + (miss**2 + (right - miss) ** 2) / right - ((p**2 + (n - p) ** 2) / n)[own]
    gain = np.where(right > 0.5, gain, 0.0)
    top = np.maximum.reduceat(gain, first[::few])
    best = np.flatnonzero(gain == top[own])
    best = best[np.flatnonzero(np.diff(own[best], prepend=-1))]
    return top, drawn[np.arange(a), place[best] % few], at[best] % BINS


def forest(x: np.ndarray, y: np.ndarray, trees: range, seed: int, weight: np.ndarray | None = None) -> tuple[Ensemble, np.ndarray]:
    """Trees by number, each on as many draws with replacement as there are rows; importances are summed over the trees."""
    out, gains = [], np.zeros(x.shape[1])
    cells = _cells(y, weight)
    total = int(cells.sum())
    at_once = max(1, min(SIDE_BY_SIDE, ROWS_AT_ONCE // max(1, len(x))))
    for first in range(0, len(trees), at_once):
        draws = []
        for t in trees[first : first + at_once]:
            rng = np.random.default_rng((seed, t))
            drawn = rng.multinomial(total, cells / total).reshape(2, -1)
            draws.append((drawn.sum(axis=0).astype(float), drawn[1].astype(float), rng))
        for tree, gain in _grown_together(x, draws):
            out.append(tree)
            gains += gain
    return Ensemble.of(out), gains


def _cells(y: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """How many negative, then how many positive rows each row stands for."""
    y = np.asarray(y).astype(np.int64)
    return np.concatenate(((np.ones(len(y), np.int64) if weight is None else weight) - y, y))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(f, -500, 500)))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int, step: float, depth: int = 3, weight: np.ndarray | None = None) -> tuple[float, Ensemble, np.ndarray]:
    """(start, trees, importances): least-squares trees of the gradient, Newton leaves, every row and column."""
    n, columns = x.shape
    held = np.ones(n) if weight is None else weight.astype(float)
    share = y.sum() / held.sum()
    start = float(np.log(share / (1 - share)))
    f, gains, trees = np.full(n, start), np.zeros(columns), []
    base = np.arange(columns) * BINS + x.astype(np.int64)
    for _ in range(rounds):
        p = _sigmoid(f)
        g, h = y - held * p, held * p * (1 - p)
        tree = _Nodes()
        at, node, names = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(1, np.int64)
        rows, gain_of = np.arange(n), np.zeros(columns)
        for _ in range(depth):
            a = len(names)
            key = (node[:, None] * (columns * BINS) + base[rows]).ravel()
            count = np.bincount(key, None if weight is None else np.repeat(held[rows], columns), a * columns * BINS).reshape(a, columns, BINS).cumsum(axis=2)
            total = np.bincount(key, np.repeat(g[rows], columns), a * columns * BINS).reshape(a, columns, BINS).cumsum(axis=2)
            m, s = count[:, :1, -1:], total[:, :1, -1:]
            left, sl = count[:, :, :-1], total[:, :, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sl**2 / left + (s - sl) ** 2 / (m - left) - s**2 / m
            gain = np.where((left > 0) & (left < m), gain, 0.0).reshape(a, -1)
            best = gain.argmax(axis=1)
            value = gain[np.arange(a), best]
            first, fresh = np.full(a, -1), []
            for i in np.flatnonzero(value > 1e-12):
                gain_of[best[i] // (BINS - 1)] += value[i]
                first[i] = len(fresh)
                child = tree.split(int(names[i]), int(best[i] // (BINS - 1)), int(best[i] % (BINS - 1)))
                fresh += [child, child + 1]
            if not fresh:
                break
            stay = first[node] >= 0
            rows, node = rows[stay], node[stay]
            node = first[node] + (x[rows, best[node] // (BINS - 1)] > best[node] % (BINS - 1))
            names = np.array(fresh)
            at[rows] = names[node]
        top, low = np.bincount(at, g, len(tree.column)), np.bincount(at, h, len(tree.column))
        values = np.where(low > 1e-150, top / np.maximum(low, 1e-150), 0.0)
        tree.value = list(step * values)
        f += np.array(tree.value)[at]
        trees.append(tree.done())
        gains += gain_of / gain_of.sum() if gain_of.sum() else gain_of
    return start, Ensemble.of(trees), gains / gains.sum() if gains.sum() else gains


def boosted_leafwise(x: np.ndarray, y: np.ndarray, rounds: int, step: float, leaves: int, share: float, seed: int, least: int = 20, weight: np.ndarray | None = None) -> tuple[float, Ensemble, np.ndarray]:
    """(start, trees, splits by column): the leaf of most gain is split next; each tree sees a share of rows and columns."""
    n, columns = x.shape
    cells = _cells(y, weight)
    total = int(cells.sum())
    mean = y.sum() / total
    start = float(np.log(mean / (1 - mean)))
    f, used, trees = np.full(n, start), np.zeros(columns), []
    for t in range(rounds):
        rng = np.random.default_rng((seed, t))
        own = np.sort(rng.permutation(columns)[: max(1, round(columns * share))])
        taken = rng.multivariate_hypergeometric(cells, max(1, int(total * share)), method="marginals").reshape(2, -1)
        held = taken.sum(axis=0).astype(float)
        bag = np.flatnonzero(held)
        p = _sigmoid(f)
        g, h = taken[1] - held * p, held * p * (1 - p)
        base = np.arange(len(own)) * BINS + x[:, own].astype(np.int64)
        size = len(own) * BINS

        def sums(rows):
            key = base[rows].ravel()
            return [np.bincount(key, w, size).reshape(len(own), BINS).cumsum(axis=1) for w in (np.repeat(held[rows], len(own)), np.repeat(g[rows], len(own)), np.repeat(h[rows], len(own)))]

        def best(of):
            count, gs, hs = of
            c, gl, hl = count[:, :-1], gs[:, :-1], hs[:, :-1]
            m, ga, ha = count[0, -1], gs[0, -1], hs[0, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl**2 / hl + (ga - gl) ** 2 / (ha - hl) - ga**2 / ha
            gain = np.where((c >= least) & (m - c >= least) & (hl >= 1e-3) & (ha - hl >= 1e-3), gain, 0.0).ravel()
            i = int(gain.argmax())
            return float(gain[i]), i // (BINS - 1), i % (BINS - 1)

        tree = _Nodes()
        whole = sums(bag)
        frontier = {0: (bag, whole, best(whole))}
        while len(frontier) < leaves:
            k = max(frontier, key=lambda i: (frontier[i][2][0], -i))
            rows, of, (gain, c, cut) = frontier[k]
            if gain <= 1e-12:
                break
            del frontier[k]
            left = tree.split(k, int(own[c]), cut)
            used[own[c]] += 1
            right = x[rows, own[c]] > cut
            parts = [rows[~right], rows[right]]
            small = int(len(parts[1]) < len(parts[0]))
            of_small = sums(parts[small])
            both = [of_small, [a - b for a, b in zip(of, of_small)]]
            for i, r in enumerate(parts):
                s = both[0] if i == small else both[1]
                frontier[left + i] = (r, s, best(s))
        for k, (_, of, _) in frontier.items():
            tree.value[k] = step * float(of[1][0, -1] / max(of[2][0, -1], 1e-150))
        one = Ensemble.of([tree.done()])
        f += one.leaves(x)[:, 0]
        trees.append(tree.done())
    return start, Ensemble.of(trees), used
