"""Certified solves: a graph that fits one task goes to the NumPy kernel, its right-hand sides to many; a larger one stays distributed."""

from __future__ import annotations

import time
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IncompatibleRhs, MaximumIterations, MemoryBudgetExceeded, PcgBreakdown
from ..functions.kernel import DIRECT, FILL, FULL, LEVELS, STAGNATED, Hierarchy, Level, LocalGraph, pcg
from ..options import EngineOptions, HierarchyOptions, PcgOptions
from . import graph as G
from .components import components, forget, written

REPORT = "rhs_id long, iterations int, relative_residual double, backward_error double, restarts int, initial_residual double, projection double"


def fits(edges: int, vertices: int, engine: EngineOptions | None = None) -> bool:
    """Whether a graph may go to one task whole: by its edges, and by its vertices, which may be isolated."""
    most = (engine or EngineOptions()).local_edges
    return edges <= most and vertices <= 2 * most


def local_graph(edges: DataFrame, engine: EngineOptions | None = None, ids: DataFrame | None = None) -> tuple[LocalGraph, np.ndarray]:
    """The graph in this process, after a check of its size, and the ids of its vertices 0, 1, ...; ids adds isolated ones."""
    engine = engine or EngineOptions()
    n, m = edges.count(), ids.count() if ids is not None else 0
    if not fits(n, m, engine):
        raise MemoryBudgetExceeded(needed=n * 24 + m * 8, budget=engine.local_edges * 24)
    t = edges.select("u", "v", "w").toArrow()
    u, v, w = (np.asarray(t.column(c)) for c in "uvw")
    more = [np.asarray(ids.select("id").toArrow().column(0))] if ids is not None else []
    names = np.unique(np.concatenate([u, v, *more]).astype(np.int64))
    return LocalGraph(len(names), np.searchsorted(names, u), np.searchsorted(names, v), w), names


def solve_batch(edges: DataFrame, rhs: DataFrame, options: PcgOptions | None = None, hierarchy: HierarchyOptions | None = None, engine: EngineOptions | None = None, retained: DataFrame | None = None) -> DataFrame:
    """From rhs(rhs_id, id, val): rows rhs_id, iterations, ..., solution (array of struct id, val).

    The hierarchy is built once and broadcast (its size is checked); each right-hand side is a task's group.
    retained: the edges that the hierarchy is built from, when the preconditioner of an older graph is kept.
    """
    g, names = local_graph(edges, engine, rhs.select("id").distinct())
    old = g
    if retained is not None:
        t, kept = local_graph(retained, engine, edges.sparkSession.createDataFrame(pd.DataFrame({"id": names})))
        old = t
        assert len(kept) == len(names), "the retained graph has other vertices"
    shared = edges.sparkSession.sparkContext.broadcast((g, names, Hierarchy.build(old, hierarchy), options or PcgOptions()))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        g, names, h, o = shared.value
        b = np.zeros(g.n)
        b[np.searchsorted(names, part["id"].to_numpy())] = part["val"].to_numpy()
        s = pcg(g, h, b, o)
        solution = [{"id": int(i), "val": float(x)} for i, x in zip(names, s.solution, strict=True)]
        return pd.DataFrame({"rhs_id": [int(part["rhs_id"].iloc[0])], "iterations": [s.iterations], "relative_residual": [s.relative_residual], "backward_error": [s.backward_error], "restarts": [s.restarts], "initial_residual": [s.initial_residual], "projection": [s.projection], "solution": [solution]})

    return rhs.groupBy("rhs_id").applyInPandas(one, REPORT + ", solution array<struct<id:long,val:double>>")


def solutions(solved: DataFrame) -> DataFrame:
    return solved.select("rhs_id", F.inline("solution"))


def solve_all(edges: DataFrame, rhs: DataFrame, options: PcgOptions | None = None, hierarchy: HierarchyOptions | None = None, engine: EngineOptions | None = None) -> DataFrame:
    """(rhs_id, id, val): solve_batch where the graph fits a task, else solve_distributed for one right-hand side after another."""
    ids = rhs.select("id").union(edges.select("u")).union(edges.select("v")).distinct()
    if fits(edges.count(), ids.count(), engine):
        return solutions(solve_batch(edges, rhs, options, hierarchy, engine))
    out = None
    for (r,) in rhs.select("rhs_id").distinct().orderBy("rhs_id").collect():
        b = ids.join(rhs.filter(F.col("rhs_id") == r).select("id", "val"), "id", "left").select("id", F.coalesce("val", F.lit(0.0)).alias("val"))
        x = solve_distributed(edges, b, options)[0].select(F.lit(r).alias("rhs_id"), "id", "val")
        out = x if out is None else out.unionByName(x)
    return out if out is not None else rhs.limit(0).select("rhs_id", "id", "val")


def solve_pieces(edges: DataFrame, rhs: DataFrame, columns: list[str], options: list[PcgOptions | None], engine: EngineOptions | None = None) -> DataFrame:
    """(i, iterations, setup, pcg, id, val): L x = b for each column i of rhs(id, ...), with its options (None: b is 0); setup and pcg are a task's seconds.

    Components are independent: those that fit a task are solved by tasks, small ones many at once and all columns on one
    hierarchy, those beyond it by solve_distributed. An absolute tolerance is that of the whole vector, so each part
    takes its share of the square; relative ones hold for the whole where they hold for each part.
    """
    engine = engine or EngineOptions()
    labels = components(edges, "u", "v")
    placed = written(rhs.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")
    links = edges.join(placed, F.col("u") == F.col("id")).groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(links, "component", "left").select("component", "n", F.coalesce("links", F.lit(0)).alias("links"))
    sizes = written(sizes, "sizes")
    most = engine.held
    large = (F.col("links") > most) | (F.col("n") > 2 * most)
    small = ~large & (F.col("links") + F.col("n") <= most // 8)
    bins = 1 + (sizes.filter(small).agg(F.sum(F.col("links") + F.col("n"))).first()[0] or 0) // max(most // 2, 1)
    part = F.when(large, None).when(small, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component"))
    parts = written(sizes.select("component", part.alias("part")), "parts")
    where = written(placed.join(parts, "component").select("id", "part"), "places")
    near = parts.filter("part is not null").select("part").distinct().count()
    far = not where.filter("part is null").isEmpty()
    share = float(np.sqrt(near + far))
    asked = [o and replace(o, absolute=o.absolute / share) for o in options]
    schema = "i int, iterations int, setup double, pcg double, id long, val double"

    def one(e: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        r = r.sort_values("id")
        names = r["id"].to_numpy()
        g = LocalGraph(len(names), np.searchsorted(names, e["u"].to_numpy()), np.searchsorted(names, e["v"].to_numpy()), e["w"].to_numpy())
        h = Hierarchy.build(g)
        setup, out = time.perf_counter() - began, []
        for i, (c, o) in enumerate(zip(columns, asked, strict=True)):
            began = time.perf_counter()
            x, k = np.zeros(g.n), 0
            if o is not None:
                s = pcg(g, h, r[c].to_numpy(float), o)
                x, k = s.solution, s.iterations
            out.append(pd.DataFrame({"i": i, "iterations": k, "setup": setup if i == 0 else 0.0, "pcg": time.perf_counter() - began, "id": names, "val": x}))
        return pd.concat(out)

    e = edges.join(where, F.col("u") == F.col("id")).select(F.col("part").alias("part"), "u", "v", "w")
    r = rhs.select("id", *columns).join(where, "id")
    tasks = max(1, min(4 * near, 2000))
    grouped = [x.filter("part is not null").repartition(tasks, "part").groupBy("part") for x in (e, r)]
    out = written(grouped[0].cogroup(grouped[1]).applyInPandas(one, schema), "pieces")
    if far:
        e, r = written(e.filter("part is null").select("u", "v", "w"), "edges"), written(r.filter("part is null"), "rhs")
        for i, (c, o) in enumerate(zip(columns, asked, strict=True)):
            x, report = r.select("id", F.lit(0.0).alias("val")), {"iterations": 0, "setup": 0.0, "pcg": 0.0}
            if o is not None:
                x, report = solve_distributed(e, r.select("id", F.col(c).alias("val")), o)
            out = out.unionByName(x.select(F.lit(i).alias("i"), *(F.lit(report[k]).alias(k) for k in ("iterations", "setup", "pcg")), "id", "val"))
    return out


def profiled(edges: DataFrame, engine: EngineOptions | None = None) -> dict[str, float]:
    """Seconds of each phase of a solve with a known solution: collect, setup, pcg. What the driver does not hold is written to the shared folder,
    and solved by solve_pieces: setup and pcg are then the sums of the tasks' seconds, and dealing the components to tasks is in no phase."""
    engine, t0 = engine or EngineOptions(), time.perf_counter()
    edges = written(edges, "edges")
    m, n = edges.count(), edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().count()
    if fits(m, n, EngineOptions(local_edges=engine.held)):
        g, _ = local_graph(edges)
        t1 = time.perf_counter()
        h = Hierarchy.build(g)
        t2 = time.perf_counter()
        x = np.sin(np.arange(g.n))
        pcg(g, h, g.times((x - x.mean())[:, None])[:, 0])
        return {"collect": t1 - t0, "setup": t2 - t1, "pcg": time.perf_counter() - t2}
    x = G.dense_ids(edges.select(F.explode(F.array("u", "v")).alias("id"))).select("id", F.sin("index").alias("val"))
    b = written(G.matvec(edges, written(x, "x")), "rhs")
    t1 = time.perf_counter()
    solved = solve_pieces(edges, b, ["val"], [PcgOptions()], engine)
    pieces = solved.select("setup", "pcg").distinct()
    setup, work = pieces.agg(F.sum("setup"), F.sum("pcg")).first()
    return {"collect": t1 - t0, "setup": setup, "pcg": work}


def solve_distributed(edges: DataFrame, b: DataFrame, options: PcgOptions | None = None) -> tuple[DataFrame, dict]:
    """Conjugate gradients with a diagonal preconditioner where every vector is a DataFrame: for graphs beyond one task.

    One pass of edges an iteration; vectors are written to the shared folder, so lost executors cost no restart, and
    deleted when the next ones are there.
    """
    o, began = options or PcgOptions(), time.perf_counter()
    comps = components(edges, "u", "v")
    labels = written(b.select("id").join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")
    pb = written(G.project_rhs(b, labels, o.compatibility), "rhs")
    scale = written(b.select("id").join(G.inverse_diagonal(edges).withColumnRenamed("val", "d"), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d")), "scale")
    bound = G.metadata(edges).first()["norm_bound"]
    size = float(np.sqrt(pb.agg(F.sum(F.col("val") ** 2)).first()[0] or 0))
    state = written(pb.join(scale, "id").select("id", F.lit(0.0).alias("x"), F.col("val").alias("r"), (F.col("d") * F.col("val")).alias("p"), "d", F.col("val").alias("b")), "state")
    rho = state.agg(F.sum(F.col("r") * F.col("r") * F.col("d"))).first()[0] or 0.0
    setup = time.perf_counter() - began
    if size == 0:
        return state.select("id", F.col("x").alias("val")), {"iterations": 0, "residual": 0.0, "setup": setup, "pcg": 0.0}
    held = state
    for k in range(1, o.max_iterations + 1):
        q = G.matvec(edges, state.select("id", F.col("p").alias("val"))).withColumnRenamed("val", "q")
        state = written(state.join(q, "id"), "state")
        forget(held)
        held = state
        curvature = state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not curvature > 0:
            raise PcgBreakdown(quantity="p'Ap", value=curvature, iteration=k)
        alpha = rho / curvature
        moved = state.select("id", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p", "d", "b")
        fresh, rr, xx = moved.agg(F.sum(F.col("r") ** 2 * F.col("d")), F.sum(F.col("r") ** 2), F.sum(F.col("x") ** 2)).first()
        target = o.absolute + o.relative * (size + bound * float(np.sqrt(xx)))
        if np.sqrt(rr) <= target or k % o.recompute == 0:
            y = G.matvec(edges, moved.select("id", F.col("x").alias("val"))).withColumnRenamed("val", "y")
            moved = written(moved.join(y, "id").select("id", "x", (F.col("b") - F.col("y")).alias("r"), "p", "d", "b"), "state")
            forget(held)
            held = moved
            fresh, rr = moved.agg(F.sum(F.col("r") ** 2 * F.col("d")), F.sum(F.col("r") ** 2)).first()
            if np.sqrt(rr) <= target:
                x = G.center(moved.select("id", F.col("x").alias("val")), labels)
                return x, {"iterations": k, "residual": float(np.sqrt(rr)), "setup": setup, "pcg": time.perf_counter() - began - setup}
            beta = 0.0
        else:
            beta = fresh / rho
        rho = fresh
        state = moved.select("id", "x", "r", (F.col("d") * F.col("r") + beta * F.col("p")).alias("p"), "d", "b")
    raise MaximumIterations(iterations=o.max_iterations, residual=float(np.sqrt(rr)))


LEVEL = "level int, vertices long, edges long, matrix_nnz long, repeat int, terminal string"


def _shown(x: Level) -> tuple:
    return x.graph.n, len(x.graph.u), x.graph.nnz, 0 if x.terminal == DIRECT else x.repeat, x.terminal


def hierarchy_tables(spark: SparkSession, h: Hierarchy) -> tuple[DataFrame, DataFrame, DataFrame]:
    """levels, hierarchy_edges and aggregations of a hierarchy."""
    levels = [(k, *_shown(x)) for k, x in enumerate(h.levels)]
    edges = [(k, int(a), int(b), float(w)) for k, x in enumerate(h.levels) for a, b, w in zip(x.graph.u, x.graph.v, x.graph.w, strict=True)]
    labels = [(k, i, int(c)) for k, x in enumerate(h.levels) if x.label is not None for i, c in enumerate(x.label) if c >= 0]
    return (
        spark.createDataFrame(levels, LEVEL),
        spark.createDataFrame(edges, "level int, u long, v long, weight double"),
        spark.createDataFrame(labels, "level int, fine_vertex long, coarse_vertex long"),
    )


def hierarchy_levels(edges: DataFrame, options: HierarchyOptions | None = None, engine: EngineOptions | None = None) -> DataFrame:
    """The levels of hierarchy_tables, of a canonical graph of any size: while a level has more edges than the driver holds, it is grouped and contracted as a DataFrame."""
    o, engine, spark = options or HierarchyOptions(), engine or EngineOptions(), edges.sparkSession
    g, rows, alone, retired, stored, finest, above = written(edges.select("u", "v", "w"), "level"), [], 0, 0, 0, None, None
    ends = lambda e: e.select(F.explode(F.array("u", "v")).alias("id")).distinct().count()
    m, met = g.count(), ends(g)
    while True:
        n, nnz = met + alone, met + 2 * m
        finest = nnz if finest is None else finest
        shown = n + (retired if o.preserve_stopping else 0)
        if fits(m, n, EngineOptions(local_edges=engine.held)) or shown < o.direct_threshold:
            break
        labels = written(grouping(g, o.low_degree).select("id", "label"), "labels")
        coarse = labels.select("label").distinct().count() + alone
        seen = coarse + (retired if o.preserve_stopping else 0)
        stored += 0 if seen == 1 else nnz
        terminal = FULL if seen == 1 else STAGNATED if seen >= shown - 1 else FILL if stored > o.fill_limit * finest else LEVELS if len(rows) + 1 >= o.max_levels else None
        if terminal:
            rows.append((len(rows), n, m, nnz, 1, terminal))
            return spark.createDataFrame(rows, LEVEL)
        down = written(G.contract(g, labels), "level")
        forget(g)
        forget(labels)
        g, above, edge_count = down, nnz, m
        m, met = g.count(), ends(g)
        alone = coarse - met
        if o.prune:
            retired, alone = retired + alone, 0
        below = met + 2 * m
        rows.append((len(rows), n, edge_count, nnz, max(nnz // below - 1, 1) if below else 1, None))
    t = g.toArrow()
    u, v, w = (np.asarray(t.column(c)) for c in "uvw")
    names = np.unique(np.concatenate([u, v]))
    h = Hierarchy.build(LocalGraph(n, np.searchsorted(names, u), np.searchsorted(names, v), w), o, (len(rows), stored, finest, retired))
    if above is not None and len(h.levels) == 1 and h.factor is not None:
        rows[-1] = (*rows[-1][:4], max(above // h.factor.entries - 1, 1) if h.factor.entries else 1, None)
    return spark.createDataFrame(rows + [(len(rows) + k, *x) for k, x in enumerate(map(_shown, h.levels))], LEVEL)


def split_parents(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """split_forest for a distributed forest: (id, parent) with cuts; roots(id, component) says which tree an id is in. A tree goes to one task, with others."""
    from ..functions.kernel import split_forest

    parts = 1 + parents.count() // 50_000

    def one(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("id")
        names = tree["id"].to_numpy()
        return pd.DataFrame({"id": names, "parent": names[split_forest(np.searchsorted(names, tree["parent"].to_numpy()))]})

    part = F.pmod(F.xxhash64("component"), F.lit(parts))
    return parents.join(roots, "id").select("id", "parent", part.alias("part")).groupBy("part").applyInPandas(one, "id long, parent long")


def grouping(edges: DataFrame, low_degree: float = 0.125) -> DataFrame:
    """(id, heavy_parent, weight, split_parent, final_parent, label), label being the smallest id of the group: all steps distributed."""
    heavy = written(G.heavy_edges(edges), "heavy")
    trees = written(components(heavy, "id", "parent"), "trees")
    cut = written(split_parents(heavy.select("id", "parent"), trees), "cut")
    final = written(G.low_degree_cuts(edges, heavy, cut, low_degree), "final")
    labels = components(final, "id", "parent")
    out = heavy.withColumnRenamed("parent", "heavy_parent").join(cut.withColumnRenamed("parent", "split_parent"), "id").join(final.withColumnRenamed("parent", "final_parent"), "id")
    return out.join(labels, "id", "left").select("id", "heavy_parent", "weight", "split_parent", "final_parent", F.coalesce("component", "id").alias("label"))


def eligible(edges: int, vertices: int, terminal: bool, engine: EngineOptions | None = None) -> bool:
    """Whether one level's work is worth splitting up: it goes on to a coarser level, has edges enough, and more of them than a tree by a quarter."""
    o = engine or EngineOptions()
    return not terminal and edges >= vertices + vertices // 4 and edges >= o.min_length


def at_once(rhs: int, workspace: int, engine: EngineOptions | None = None) -> int:
    """Right-hand sides at a time: as many as there are threads and the budget holds workspaces for."""
    o = engine or EngineOptions()
    return min(o.threads, rhs, o.budget // max(workspace, 1))


def route(rhs: int, edges: int, vertices: int, engine: EngineOptions | None = None) -> tuple[str, int]:
    """How a batch would run and how many right-hand sides at a time: Serial, Planned (one solve split up) or AcrossRHS."""
    o = engine or EngineOptions()
    n = at_once(rhs, 64 * max(vertices, 1), o)
    if rhs > 1 and n >= 2:
        return "AcrossRHS", n
    return ("Planned" if eligible(edges, vertices, False, o) and edges >= o.planned_edges else "Serial"), 1


def check_compatible(b: DataFrame, comps: DataFrame, tolerance: float = 1e-7) -> None:
    """Fails with the first component, by label, whose right-hand side does not sum to nearly 0."""
    bad = G.component_sums(b, comps).filter(F.abs("total") > tolerance * F.greatest(F.lit(1.0), "scale")).orderBy("component").first()
    if bad:
        raise IncompatibleRhs(total=bad["total"], component=bad["component"], allowed=tolerance * max(1.0, bad["scale"]))
