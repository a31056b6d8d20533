"""Graphs of more edges than one process holds give what smaller ones give at once."""

import numpy as np
import pytest

from meshwright.operators import graph as G
from meshwright.operators import solve
from meshwright.options import EngineOptions, HierarchyOptions, PcgOptions
from meshwright.plans.catalog import parts
from meshwright.sources import generators as gen


def levels(df):
    return [tuple(r) for r in df.orderBy("level").collect()]


@pytest.mark.parametrize("options", [HierarchyOptions(direct_threshold=50), HierarchyOptions(direct_threshold=50, prune=True), HierarchyOptions(direct_threshold=2, max_levels=3), HierarchyOptions(direct_threshold=2, fill_limit=1.2)])
def test_levels_of_a_graph_beyond_the_driver(spark, options):
    apart = gen.path(spark, 40).selectExpr("u + 20000000 as u", "v + 20000000 as v", "w")
    e = G.canonical(parts(spark, "/root/testdata/sf0.001").unionByName(apart)).cache()
    g, _ = solve.local_graph(e)
    want = levels(solve.hierarchy_tables(spark, solve.Hierarchy.build(g, options))[0])
    for most in (1000, 1):
        assert levels(solve.hierarchy_levels(e, options, EngineOptions(part_edges=most))) == want


def test_components_are_solved_apart(spark):
    e = G.canonical(gen.grid(spark, 400).unionByName(gen.path(spark, 60).selectExpr("u + 1000 as u", "v + 1000 as v", "w")).unionByName(gen.path(spark, 9).selectExpr("u + 2000 as u", "v + 2000 as v", "w"))).cache()
    ids = [*range(400), *range(1000, 1060), *range(2000, 2009), 3000]
    x = {i: float(np.sin(i)) for i in ids}
    b = G.matvec(e, spark.createDataFrame(list(x.items()), "id long, val double")).selectExpr("id", "val as p", "0.0D as z", "3 * val as q").cache()
    g, names = solve.local_graph(e, ids=b.select("id"))
    root = solve.Hierarchy.build(g).levels[0].root
    mean = {r: np.mean([x[int(i)] for i in names[root == r]]) for r in set(root.tolist())}
    want = {int(i): x[int(i)] - mean[int(r)] for i, r in zip(names, root, strict=True)}
    for most in (1_000_000, 800):  # all in one part; two parts and one of what is small
        got = solve.solve_pieces(e, b, ["p", "z", "q"], [PcgOptions(relative=0, absolute=1e-8), None, PcgOptions()], EngineOptions(part_edges=most)).collect()
        assert sorted((r["i"], r["id"]) for r in got) == sorted((i, k) for i in range(3) for k in ids)
        for r in got:
            assert abs(r["val"] - (1, 0, 3)[r["i"]] * want[r["id"]]) < 1e-4


def test_a_component_beyond_a_task(spark):
    e = G.canonical(gen.path(spark, 6).unionByName(gen.path(spark, 3).selectExpr("u + 10 as u", "v + 10 as v", "w"))).cache()
    b = G.matvec(e, spark.createDataFrame([(i, float(i % 3)) for i in (*range(6), 10, 11, 12)], "id long, val double"))
    got = solve.solve_pieces(e, b, ["val"], [PcgOptions(relative=0, absolute=1e-9)], EngineOptions(part_edges=4)).collect()
    assert {r["id"]: round(r["val"], 6) for r in got} == {i: i % 3 - 1.0 for i in range(6)} | {i: i % 3 - 1.0 for i in (10, 11, 12)}


def test_profile_of_a_graph_beyond_the_driver(spark):
    e = gen.path(spark, 9).unionByName(gen.path(spark, 9).selectExpr("u + 10 as u", "v + 10 as v", "w"))
    for most in (1_000_000, 10):
        seconds = solve.profiled(e, EngineOptions(part_edges=most))
        assert list(seconds) == ["collect", "setup", "pcg"] and min(seconds.values()) > 0


def test_panel_of_components_that_fit_tasks(spark, monkeypatch):
    from meshwright.operators import panel

    one = spark.range(60).selectExpr("id as obs", "id % 10 as a", "(id * 7) % 6 as b", "1.0D + id % 3 as w", "cast(id * id % 17 as double) as y", "cast(id * id % 11 as double) as x")
    p = one.unionByName(one.selectExpr("obs + 100", "a + 100", "b + 100", "w", "y", "x").toDF(*one.columns)).cache()
    near, _ = panel.demean(p, ["y", "x"], 1e-9)
    monkeypatch.setattr(solve, "solve_distributed", None)  # no component needs it
    far, _ = panel.demean(p, ["y", "x"], 1e-9, engine=EngineOptions(part_edges=5))
    for r, s in zip(near.orderBy("obs").collect(), far.orderBy("obs").collect(), strict=True):
        assert abs(r["y_resid"] - s["y_resid"]) < 1e-7 and abs(r["x_resid"] - s["x_resid"]) < 1e-7
