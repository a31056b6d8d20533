"""The kernel against small exact cases and dense algebra."""

import numpy as np
import pytest

from meshwright import errors
from meshwright.functions.kernel import Factor, Hierarchy, LocalGraph, grouping, heavy_parents, pcg, projected, smallest_members, split_forest
from meshwright.options import HierarchyOptions, PcgOptions


def path(n, w=1.0):
    return LocalGraph(n, np.arange(n - 1), np.arange(1, n), np.full(n - 1, w) if np.isscalar(w) else w)


def dense(g):
    return g.times(np.eye(g.n))


# A graph of two rings joined by two edges.
TOY = [(0, 1, 4.0), (0, 5, 1.2), (1, 2, 3.0), (1, 4, 0.8), (2, 3, 2.0), (2, 6, 0.4), (3, 4, 1.0), (4, 5, 2.5), (4, 8, 0.25), (6, 7, 4.0), (6, 11, 1.2), (7, 8, 3.0), (7, 10, 0.8), (8, 9, 2.0), (9, 10, 1.0), (10, 11, 2.5)]


def toy():
    u, v, w = map(np.array, zip(*TOY, strict=True))
    return LocalGraph(12, u, v, w)


def test_small_exact_graphs():
    g = LocalGraph(4, np.array([0, 1, 1]), np.array([1, 2, 3]), np.array([1.5, 0.5, 4.0]))
    x = np.array([[2.0], [0.0], [-4.0], [1.0]])
    assert g.degree.tolist() == [1.5, 6, 0.5, 4]
    assert g.times(x)[:, 0].tolist() == [3, -5, -2, 4]
    assert g.energy(x).tolist() == [18]
    g = LocalGraph(5, np.array([4, 2, 0, 1, 2]), np.array([0, 1, 4, 2, 3]), np.array([1.0, 0.5, 2.0, 0.25, 8.0]))
    assert list(zip(g.u.tolist(), g.v.tolist(), g.w.tolist(), strict=True)) == [(0, 4, 3.0), (1, 2, 0.75), (2, 3, 8.0)]


def test_forest():
    parent, weight = heavy_parents(LocalGraph(4, np.array([0, 0, 1, 2]), np.array([1, 3, 3, 3]), np.array([2.0, 2, 7, 7])))
    assert parent.tolist() == [1, 3, 3, 1] and weight.tolist() == [2, 7, 7, 7]
    # A published path and its cut.
    assert split_forest(np.array([1, 0, 1, 2, 3, 4, 5, 6])).tolist() == [1, 0, 1, 2, 4, 4, 5, 6]
    small = np.array([0, 0, 0, 1, 1, 2])  # fewer vertices than any cut takes
    assert split_forest(small).tolist() == small.tolist()
    two_stars = np.array([0, 0, 0, 0, 0, 0, 5, 5, 5, 5])  # two centres, joined by the edge 5-0: each has more than two others
    assert split_forest(two_stars)[5] in (0, 5) and (split_forest(two_stars)[[6, 7, 8, 9]] == 5).all()
    k12 = LocalGraph(12, *np.triu_indices(12, 1), np.full(66, 3.0))
    assert grouping(k12, 0.125)["final_parent"].tolist() == [1, 0, *range(2, 12)]
    lone = grouping(LocalGraph(6, np.array([2]), np.array([5]), np.array([0.5])), 0.125)
    assert lone["label"].tolist() == [0, 1, 2, 3, 4, 2]


def test_splitting_keeps_trees_apart_and_paths_short():
    rng = np.random.default_rng(11)
    for n in (1, 8, 60, 400):
        for reach in (1, 3, n):
            parents = np.maximum(np.arange(n) - rng.integers(1, reach + 1, n), 0)
            cut = split_forest(parents)
            assert ((cut == parents) | (cut == np.arange(n))).all()  # it only makes roots
            shift = rng.integers(0, 3, n).cumsum()  # other names in the same order, and strangers between: the same cuts
            wide = np.arange(shift[-1] + n)
            wide[shift + np.arange(n)] = (shift + np.arange(n))[parents]
            assert (split_forest(wide)[shift + np.arange(n)] == (shift + np.arange(n))[cut]).all()
            depth, at = np.zeros(n, int), np.arange(n)
            while (cut[at] != at).any():
                depth += cut[at] != at
                at = cut[at]
            assert depth.max(initial=0) <= 2 * 6


def test_toy_hierarchy_and_solve():
    g = toy()
    h = Hierarchy.build(g, HierarchyOptions(direct_threshold=3))
    assert [(x.graph.n, len(x.graph.u), x.graph.nnz, x.repeat, x.terminal) for x in h.levels] == [(12, 16, 44, 2, None), (4, 4, 12, 11, None), (2, 1, 4, 1, "Direct")]
    t = np.sin((np.arange(12) + 1) * 0.71) + 0.2 * np.arange(12)
    t -= t.mean()
    s = pcg(g, h, g.times(t[:, None])[:, 0])
    assert s.iterations == 7 and abs(s.backward_error - 8.414e-10) < 1e-13
    assert np.abs(s.solution - t).max() < 1e-6


def test_terminal_rules():
    wheel = LocalGraph(9, np.zeros(8, int), np.arange(1, 9), np.linspace(1, 2, 8))
    k14 = LocalGraph(14, *np.triu_indices(14, 1), np.full(91, 0.25))
    cases = [(path(5), {}, "Direct"), (wheel, {"direct_threshold": 1}, "FullContraction"), (k14, {"direct_threshold": 1}, "StagnatedVertexReduction"), (path(40), {"direct_threshold": 2, "fill_limit": 0.75}, "StagnatedFill"), (path(40), {"direct_threshold": 2, "max_levels": 1}, "MaximumLevels")]
    for g, o, reason in cases:
        assert Hierarchy.build(g, HierarchyOptions(**o)).levels[-1].terminal == reason


def test_pruning_sizes():
    n, m = 4096, 1000
    g = LocalGraph(n + 2 * m, np.concatenate([np.arange(n - 1), n + 2 * np.arange(m)]), np.concatenate([np.arange(1, n), n + 1 + 2 * np.arange(m)]), np.ones(n - 1 + m))
    assert [x.graph.n for x in Hierarchy.build(g).levels] == [6096, 2024, 1256, 1064, 1016, 1004, 1001]
    assert [x.graph.n for x in Hierarchy.build(g, HierarchyOptions(prune=True)).levels] == [6096, 1024, 256]


def test_cycle_is_linear_symmetric_and_positive():
    rng = np.random.default_rng(1)
    g = toy()
    h = Hierarchy.build(g, HierarchyOptions(direct_threshold=3))
    p = np.eye(12) - 1 / 12
    m = p @ h.apply(p)
    assert np.abs(m - m.T).max() < 1e-12
    assert np.sort(np.linalg.eigvalsh(m))[1] > 0
    x, y = rng.normal(size=(2, 12, 1))
    assert np.abs(h.apply(2 * x - 3 * y) - 2 * h.apply(x) + 3 * h.apply(y)).max() < 1e-12
    both = np.hstack([x, y])
    assert np.abs(h.apply(both)[:, :1] - h.apply(x)).max() < 1e-13


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
def test_solves_match_dense_algebra(scale):
    rng = np.random.default_rng(7)
    for _ in range(5):
        n, m = 60, 90
        u, v = rng.integers(0, n, (2, m))
        keep = u != v
        g = LocalGraph(n, u[keep], v[keep], rng.uniform(0.1, 2, keep.sum()) * scale)
        root = smallest_members(g.n, g.u, g.v)
        b = g.times(rng.normal(size=(n, 1)))[:, 0]
        for threshold in (1, 20, 700):
            s = pcg(g, Hierarchy.build(g, HierarchyOptions(direct_threshold=threshold)), b, PcgOptions(relative=1e-12))
            want = np.linalg.pinv(dense(g)) @ b
            assert np.abs(s.solution - want).max() < 1e-6 * max(1, np.abs(want).max())
            for r in np.unique(root):
                assert abs(s.solution[root == r].sum()) < 1e-6 * max(1, np.abs(want).max())


def test_factor_grounds_each_component():
    g = LocalGraph(6, np.array([1, 0, 4]), np.array([2, 1, 5]), np.array([5.0, 0.5, 8.0]))
    f = Factor(g)
    assert f.anchors.tolist() == [2, 3, 5]
    x = f.solve(np.array([[1.0], [4.0], [-5.0], [0.0], [-4.0], [4.0]]))[:, 0]
    assert np.allclose(x, [3, 1, 0, 0, -0.5, 0])


def test_errors():
    g = path(4)
    root = smallest_members(4, g.u, g.v)
    assert abs(projected(np.array([-2e9, 3e-8, 0, 2e9]), root, 1e-7).sum()) == 0
    with pytest.raises(errors.IncompatibleRhs):
        projected(np.array([0.5, 0, 0.25, 0]), root, 1e-7)
    with pytest.raises(errors.NonFiniteValue):
        projected(np.array([np.nan, 0, 0, 0]), root, 1e-7)
    with pytest.raises(errors.MaximumIterations):
        pcg(path(400), Hierarchy.build(path(400), HierarchyOptions(direct_threshold=2)), np.r_[1.0, np.zeros(398), -1.0], PcgOptions(max_iterations=1))
    with pytest.raises(errors.InvalidOption):
        HierarchyOptions(direct_threshold=0)
    with pytest.raises(errors.InvalidOption):
        PcgOptions(relative=0, absolute=0)
    assert "vertex 3" in str(errors.VertexOutOfBounds(vertex=3, vertex_count=2))
