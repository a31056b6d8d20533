"""The solver of one task: multilevel cycle, grounded factor and certified conjugate gradients on NumPy arrays.

Vectors are (n, k): k right-hand sides share every traversal. Nothing here knows of Spark.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np

from ..errors import IncompatibleRhs, MaximumIterations, NonFiniteValue, NonPositivePivot, PcgBreakdown, ResidualVerificationFailed
from ..options import HierarchyOptions, PcgOptions

DIRECT, FULL, STAGNATED, FILL, LEVELS = "Direct", "FullContraction", "StagnatedVertexReduction", "StagnatedFill", "MaximumLevels"


class LocalGraph:
    """A weighted graph with vertices 0..n-1: unique edges u < v, and its Laplacian."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        a, b = np.minimum(u, v).astype(np.int64), np.maximum(u, v).astype(np.int64)
        order = np.lexsort((w, b, a))
        a, b, w = a[order], b[order], np.asarray(w, float)[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        self.n, self.u, self.v = int(n), a[first], b[first]
        self.w = np.add.reduceat(w, first) if len(first) else np.zeros(0)
        row, col, both = np.concatenate([self.u, self.v]), np.concatenate([self.v, self.u]), np.concatenate([self.w, self.w])
        order = np.lexsort((col, row))
        self.row, self.col, self.both = row[order], col[order], both[order]
        self.degree = np.bincount(self.row, self.both, self.n)
        self.used = np.flatnonzero(np.bincount(self.row, minlength=self.n))
        self.start = np.searchsorted(self.row, self.used)

    @property
    def nnz(self) -> int:
        return int(np.count_nonzero(self.degree)) + 2 * len(self.u)

    @property
    def norm_bound(self) -> float:
        return 2 * float(self.degree.max(initial=0))

    def times(self, x: np.ndarray) -> np.ndarray:
        y = self.degree[:, None] * x
        if len(self.used):
            y[self.used] -= np.add.reduceat(self.both[:, None] * x[self.col], self.start, axis=0)
        return y

    def energy(self, x: np.ndarray) -> np.ndarray:
        return (self.w[:, None] * (x[self.u] - x[self.v]) ** 2).sum(axis=0)


def numbered(root: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... in the order of the roots, each being its class's smallest member."""
    return np.unique(root, return_inverse=True)[1]


def smallest_members(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's component."""
    root = np.arange(n)
    while len(u):
        least = root.copy()
        np.minimum.at(least, root[u], root[v])
        np.minimum.at(least, root[v], root[u])
        while (least[least] != least).any():
            least = least[least]
        root = least[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def heavy_parents(g: LocalGraph) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex's neighbour by its heaviest edge, the smallest among equals, and the weight; isolated ones: themselves, 0."""
    parent, weight = np.arange(g.n), np.zeros(g.n)
    order = np.lexsort((g.col, -g.both, g.row))
    best = order[np.flatnonzero(np.append(True, g.row[order][1:] != g.row[order][:-1]))] if len(order) else order
    parent[g.row[best]], weight[g.row[best]] = g.col[best], g.both[best]
    return parent, weight


#: Hops after which a path is too long, and the vertices that a part must have gained on both sides of an edge to be cut there.
LONG, HEAVY = 5, 2


class Forest:
    """A forest that is cut while its leaves are taken in turn: `up` are the parents, `gain` is what each vertex was credited with from below."""

    def __init__(self, parents: np.ndarray) -> None:
        n = len(parents)
        self.up = parents.tolist()
        self.children = np.bincount(parents[parents != np.arange(n)], minlength=n).tolist()
        self.gain, self.seen = [0] * n, [False] * n

    def above(self, at: int, below: int | None = None) -> Iterator[int]:
        """What stands above a vertex, to the root or to the pair whose members are each other's parents; below: where one came from."""
        below = at if below is None else below
        while (x := self.up[at]) not in (at, below):
            below, at = at, x
            yield x

    def cut(self, at: int, losers: Iterable[int]) -> None:
        """Makes at a root; what it was credited with is taken from the losers, its parent first."""
        losers = list(losers)
        self.up[at] = at
        self.children[losers[0]] -= 1
        for x in losers:
            self.gain[x] -= self.gain[at]

    def climb(self, leaf: int) -> int | None:
        """Credits the path above an unseen leaf. A long one is cut in its middle, and the vertex over the cut is returned, a leaf perhaps."""
        if self.children[leaf] or self.seen[leaf]:
            return None
        path = [leaf]
        for x in self.above(leaf):
            if len(path) > LONG + 1 and not self.seen[path[-1]]:
                break
            path.append(x)
        gains = accumulate((not self.seen[x] for x in path[1:]), initial=0)
        kept, rest = (path, []) if len(path) <= LONG + 1 else (path[: (len(path) + 1) // 2], path[(len(path) + 1) // 2 :])
        if rest:
            self.cut(kept[-1], rest)
        for x, more in zip(kept, gains, strict=False):
            self.gain[x] += more
            self.seen[x] = True
        return rest[0] if rest else None

    def part(self, leaf: int) -> int | None:
        """Cuts the lowest edge above a leaf with much on both sides, and returns the vertex over it."""
        if self.children[leaf]:
            return None
        below, at = leaf, leaf
        for x in self.above(leaf):
            if self.gain[at] > HEAVY and self.gain[x] - self.gain[at] > HEAVY:
                self.cut(at, [x, *self.above(x, at)])
                return x
            below, at = at, x
        return None


def split_forest(parents: np.ndarray) -> np.ndarray:
    """Cuts long paths of a forest of parents, then edges with much on both sides; leaves are taken in ascending order.

    Either cut takes a path of LONG + 2 vertices or two parts of more than HEAVY gained vertices, so trees of
    fewer are left as they are, and only the others are walked.
    """
    out = np.array(parents, np.int64)
    n = len(out)
    tree = smallest_members(n, np.arange(n), out)
    walked = np.flatnonzero(np.bincount(tree, minlength=n)[tree] >= min(LONG + 2, 2 * HEAVY + 3))
    f = Forest(np.searchsorted(walked, out[walked]))
    for turn in (f.climb, f.part):
        for leaf in range(len(walked)):
            at: int | None = leaf
            while at is not None:
                at = turn(at)
    out[walked] = walked[f.up]
    return out


def grouping(g: LocalGraph, low: float) -> dict[str, np.ndarray]:
    """Heavy parents and weights, parents after splitting and after cutting weakly held vertices, and labels."""
    heavy, weight = heavy_parents(g)
    cut = split_forest(heavy)
    final = cut.copy()
    held = g.degree > 0
    share = np.divide(weight, g.degree, out=np.ones(g.n), where=held)
    if (held & (share < low)).any():
        tree = np.zeros(g.n)
        moved = np.flatnonzero(cut != np.arange(g.n))
        np.add.at(tree, moved, weight[moved])
        np.add.at(tree, cut[moved], weight[moved])
        final[held & (tree < low * g.degree)] = np.flatnonzero(held & (tree < low * g.degree))
    moved = np.flatnonzero(final != np.arange(g.n))
    return {"heavy_parent": heavy, "heavy_weight": weight, "split_parent": cut, "final_parent": final, "label": numbered(smallest_members(g.n, moved, final[moved]))}


def contract(g: LocalGraph, label: np.ndarray, n: int) -> LocalGraph:
    a, b = label[g.u], label[g.v]
    apart = a != b
    return LocalGraph(n, a[apart], b[apart], g.w[apart])


def triangular_inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangle, by halves."""
    n = len(a)
    if n <= 32:
        return np.linalg.inv(a)
    h = n // 2
    out = np.zeros_like(a)
    out[:h, :h], out[h:, h:] = triangular_inverse(a[:h, :h]), triangular_inverse(a[h:, h:])
    out[h:, :h] = -out[h:, h:] @ (a[h:, :h] @ out[:h, :h])
    return out


class Factor:
    """LDL' of the Laplacian without each component's largest vertex, whose value is 0."""

    def __init__(self, g: LocalGraph) -> None:
        root = smallest_members(g.n, g.u, g.v)
        self.anchors = np.unique([np.flatnonzero(root == r)[-1] for r in np.unique(root)]) if g.n <= 64 else np.array(sorted({r: i for i, r in enumerate(root.tolist())}.values()), np.int64)
        free = np.ones(g.n, bool)
        free[self.anchors] = False
        inner = free[g.row] & free[g.col]
        pattern = np.bincount(g.row[inner], minlength=g.n)
        active = np.flatnonzero(free)
        self.order = active[np.lexsort((active, pattern[active]))]
        self.n, m = g.n, len(active)
        place = np.full(g.n, -1)
        place[self.order] = np.arange(m)
        a = np.zeros((m, m))
        a[place[g.row[inner]], place[g.col[inner]]] = -g.both[inner]
        a[np.arange(m), np.arange(m)] = g.degree[self.order]
        filled = a != 0
        self.entries = m
        for k in range(m):  # the pattern of the factor
            rows = np.flatnonzero(filled[k + 1 :, k]) + k + 1
            self.entries += len(rows)
            filled[np.ix_(rows, rows)] = True
        if m:
            try:
                self.lower = np.linalg.cholesky(a)
                self.inverse = triangular_inverse(self.lower)  # applied in every cycle
            except np.linalg.LinAlgError as e:
                raise NonPositivePivot(index=-1, value=str(e)) from e

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = np.zeros_like(b)
        if len(self.order):
            x[self.order] = self.inverse.T @ (self.inverse @ b[self.order])
        return x

    @property
    def pivots(self) -> np.ndarray:
        return np.diag(self.lower) ** 2 if len(self.order) else np.zeros(0)


@dataclass
class Level:
    graph: LocalGraph
    inverse: np.ndarray
    label: np.ndarray | None = None  # of the next level's vertex; -1: none
    repeat: int = 1
    terminal: str | None = None
    root: np.ndarray | None = None


def centered(x: np.ndarray, root: np.ndarray) -> np.ndarray:
    """x less its mean over each component."""
    size = np.bincount(root, minlength=len(root))
    out = np.empty_like(x)
    for j in range(x.shape[1]):
        total = np.bincount(root, x[:, j], len(root))
        out[:, j] = x[:, j] - total[root] / size[root]
    return out


@dataclass
class Hierarchy:
    levels: list[Level]
    factor: Factor | None
    seconds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def build(cls, g: LocalGraph, o: HierarchyOptions | None = None, above: tuple[int, int, int, int] | None = None) -> Hierarchy:
        """above: how many finer levels were made elsewhere, their stored entries, those of the finest, and vertices retired there."""
        o = o or HierarchyOptions()
        depth, stored, finest, retired = above or (0, 0, g.nnz, 0)
        levels, began = [], time.perf_counter()
        while True:
            n = g.n + (retired if o.preserve_stopping else 0)
            level = Level(g, np.divide(0.5, g.degree, out=np.zeros(g.n), where=g.degree > 0), root=smallest_members(g.n, g.u, g.v))
            levels.append(level)
            if g.n == 0 or n <= 1 or n < o.direct_threshold:
                level.terminal = DIRECT
                break
            label = grouping(g, o.low_degree)["label"]
            coarse = int(label.max()) + 1
            shown = coarse + (retired if o.preserve_stopping else 0)
            if shown == 1:
                level.terminal, level.label = FULL, label
                break
            stored += g.nnz
            if shown >= n - 1:
                level.terminal, level.label = STAGNATED, label
                break
            if stored > o.fill_limit * finest:
                level.terminal, level.label = FILL, label
                break
            if depth + len(levels) >= o.max_levels:
                level.terminal, level.label = LEVELS, label
                break
            down = contract(g, label, coarse)
            if o.prune:
                keep = down.degree > 0
                retired += int((~keep).sum())
                new = np.where(keep, np.cumsum(keep) - 1, -1)
                label = new[label]
                down = LocalGraph(int(keep.sum()), new[down.u], new[down.v], down.w)
            level.label = label
            level.repeat = max(g.nnz // down.nnz - 1, 1) if down.nnz else 1
            g = down
        out = cls(levels, None)
        if levels[-1].terminal == DIRECT:
            out.factor = Factor(levels[-1].graph)
            if len(levels) > 1:
                levels[-2].repeat = max(levels[-2].graph.nnz // out.factor.entries - 1, 1) if out.factor.entries else 1
        out.seconds["setup"] = time.perf_counter() - began
        return out

    def apply(self, b: np.ndarray) -> np.ndarray:
        """One cycle for b of shape (n, k)."""
        return self._cycle(0, b, 1)

    def _cycle(self, k: int, b: np.ndarray, times: int) -> np.ndarray:
        level = self.levels[k]
        if level.terminal == DIRECT:
            return self.factor.solve(b)
        scale = level.inverse[:, None]
        if level.terminal:
            return scale * b
        g, label = level.graph, level.label
        kept = np.flatnonzero(label >= 0)
        down = self.levels[k + 1]
        for i in range(times):
            x = scale * b if i == 0 else x + scale * (b - g.times(x))
            if down.graph.n:
                r = b - g.times(x)
                coarse = np.column_stack([np.bincount(label[kept], r[kept, j], down.graph.n) for j in range(b.shape[1])])
                y = self._cycle(k + 1, centered(coarse, down.root), level.repeat)
                x[kept] += y[label[kept]]
            x = x + scale * (b - g.times(x))
        return x


@dataclass
class Solved:
    solution: np.ndarray
    iterations: int
    residual: float
    relative_residual: float
    backward_error: float
    restarts: int
    initial_residual: float
    projection: float


def projected(b: np.ndarray, root: np.ndarray, tolerance: float) -> np.ndarray:
    """b without its component means, after the check that they are small."""
    if not np.isfinite(b).all():
        raise NonFiniteValue(index=int(np.flatnonzero(~np.isfinite(b))[0]))
    total, scale = np.bincount(root, b, len(root)), np.bincount(root, np.abs(b), len(root))
    bad = np.flatnonzero(np.abs(total) > tolerance * np.maximum(1, scale))
    if len(bad):
        raise IncompatibleRhs(total=float(total[bad[0]]), component=int(bad[0]), allowed=float(tolerance * max(1, scale[bad[0]])))
    out = centered(b[:, None], root)[:, 0]
    at = np.lexsort((np.arange(len(b)), np.abs(out), root))  # what rounding leaves goes to the smallest value
    first = at[np.flatnonzero(np.append(True, root[at][1:] != root[at][:-1]))] if len(b) else at
    for _ in range(2):
        out[first] -= np.bincount(root, out, len(root))[root[first]]
    return out


def pcg(g: LocalGraph, m: Hierarchy, b: np.ndarray, o: PcgOptions | None = None, guess: np.ndarray | None = None, trace: list[float] | None = None) -> Solved:
    """Solves L x = b by preconditioned conjugate gradients; ends only on a residual computed afresh."""
    o = o or PcgOptions()
    root = m.levels[0].root if len(m.levels[0].root) == g.n else smallest_members(g.n, g.u, g.v)
    times = lambda x: g.times(x[:, None])[:, 0]
    mean_free = lambda x: centered(x[:, None], root)[:, 0]
    pb = projected(b, root, o.compatibility)
    lost, size, bound = b - pb, float(np.linalg.norm(b)), g.norm_bound

    def done(x: np.ndarray, r: np.ndarray, k: int, restarts: int, start: float) -> Solved:
        left = float(np.linalg.norm(r + lost))
        scale = size + bound * float(np.linalg.norm(x))
        return Solved(x, k, left, left / size if size else left, left / scale if scale else left, restarts, start, float(np.linalg.norm(lost)))

    target = lambda x: o.absolute + o.relative * (size + bound * float(np.linalg.norm(x)))
    x = np.zeros(g.n) if guess is None else mean_free(np.asarray(guess, float))
    r = pb - times(x)
    start = float(np.linalg.norm(r))
    if trace is not None:
        trace.append(start)
    if start <= target(x):
        return done(x, r, 0, 0, start)
    apply = lambda r: mean_free(m.apply(r[:, None])[:, 0])
    z = apply(r)
    rho, p, restarts = float(r @ z), z, 0
    for k in range(1, o.max_iterations + 1):
        if not (np.isfinite(rho) and rho > 0):
            raise PcgBreakdown(quantity="r'Mr", value=rho, iteration=k)
        q = times(p)
        curvature = float(p @ q)
        if not (np.isfinite(curvature) and curvature > 0):
            raise PcgBreakdown(quantity="p'Ap", value=curvature, iteration=k)
        alpha = rho / curvature
        x = mean_free(x + alpha * p)
        r = r - alpha * q
        fresh = False
        if np.linalg.norm(r) <= target(x) or k % o.recompute == 0:
            r, fresh = pb - times(x), True
            restarts += 1
            if np.linalg.norm(r) <= target(x) and np.linalg.norm(r + lost) <= target(x):
                if trace is not None:
                    trace.append(float(np.linalg.norm(r)))
                return done(x, r, k, restarts, start)
        r = mean_free(r)
        if trace is not None:
            trace.append(float(np.linalg.norm(r)))
        z = apply(r)
        old, rho = rho, float(r @ z)
        p = z if fresh else z + rho / old * p
    if np.linalg.norm(pb - times(x)) <= target(x):
        raise ResidualVerificationFailed(residual=float(np.linalg.norm(b - times(x))), target=target(x))
    raise MaximumIterations(iterations=o.max_iterations, residual=float(np.linalg.norm(pb - times(x))))
