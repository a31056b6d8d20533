"""Weighted graphs as DataFrames: edges (u, v, w), vectors (id, val), labels (id, label).

Every operator is one lazy plan. Sums over a vertex's edges are aggregates with partial sums, so a vertex
with very many edges is no hot spot; joins on it may be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sums import compensated
from .components import written


def _refuse(bad: Column, what: str, *shown: str) -> Column:
    return F.when(bad, F.raise_error(F.concat_ws(" ", F.lit(what), *(F.col(c).cast("string") for c in shown))))


def validated(edges: DataFrame, vertex_count: int | None = None) -> DataFrame:
    """edges, failing when read at an endpoint out of range or wider than 32 bits, a loop, or a weight that is not finite and positive."""
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    top = F.greatest(u, v)
    checked = F.coalesce(
        _refuse(u.isNull() | v.isNull() | w.isNull(), "an edge has a null:", "u", "v", "w"),
        _refuse((F.least(u, v) < 0) | (top >= vertex_count) if vertex_count is not None else F.least(u, v) < 0, "VertexOutOfBounds:", "u", "v"),
        _refuse(top > 0xFFFFFFFF, "VertexIndexTooWide:", "u", "v"),
        _refuse(u == v, "SelfLoop:", "u"),
        _refuse(F.isnan(w) | (w <= 0) | (w == float("inf")), "InvalidEdgeWeight:", "u", "v", "w"),
        w,
    )
    return edges.select("u", "v", checked.alias("w"))


def canonical(edges: DataFrame, vertex_count: int | None = None, exact: bool = False) -> DataFrame:
    """One row for each unordered pair, u < v, weights summed. exact: compensated, in ascending order, whatever the partitioning."""
    pairs = validated(edges, vertex_count).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v")
    total = pairs.agg((compensated(F.array_sort(F.collect_list("w"))) if exact else F.sum("w")).alias("w"))
    return total.select("u", "v", F.coalesce(_refuse(F.col("w") == float("inf"), "InvalidEdgeWeight:", "u", "v", "w"), F.col("w")).alias("w"))


def both(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, as (id, nbr, w): one pass over edges."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("id"), F.col("u").alias("nbr"))))
    return edges.select(ends.alias("e"), "w").select("e.id", "e.nbr", "w")


def degrees(edges: DataFrame) -> DataFrame:
    return both(edges).groupBy("id").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("links"))


def metadata(edges: DataFrame, vertex_count: int | None = None) -> DataFrame:
    """vertex_count, edge_count, matrix_nnz, norm_bound of a canonical graph; by default its vertices are its endpoints."""
    d = degrees(edges).agg(F.count(F.lit(1)).alias("n"), F.sum("links").alias("links"), F.max("degree").alias("top"))
    links = F.coalesce("links", F.lit(0))
    return d.select((F.lit(vertex_count) if vertex_count is not None else F.col("n")).cast("long").alias("vertex_count"), (links / 2).cast("long").alias("edge_count"), (F.col("n") + links).alias("matrix_nnz"), (2 * F.coalesce("top", F.lit(0.0))).alias("norm_bound"))


def matvec(edges: DataFrame, x: DataFrame) -> DataFrame:
    """L x at every id of x: degree * x minus the weighted sum of the neighbours; isolated ids get 0."""
    gathered = both(edges).join(x.select(F.col("id").alias("nbr"), F.col("val").alias("_n")), "nbr").groupBy("id").agg(F.sum(F.col("w") * F.col("_n")).alias("_s"), F.sum("w").alias("_d"))
    return x.join(gathered, "id", "left").select("id", F.coalesce(F.col("_d") * F.col("val") - F.col("_s"), F.lit(0.0)).alias("val"))


def energy(edges: DataFrame, x: DataFrame) -> DataFrame:
    a, b = (x.select(F.col("id").alias(c), F.col("val").alias(f"x{c}")) for c in "uv")
    return edges.join(a, "u").join(b, "v").agg(F.sum(F.col("w") * (F.col("xu") - F.col("xv")) ** 2).alias("energy"))


def inverse_diagonal(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("id", F.when(F.col("degree") > 0, 0.5 / F.col("degree")).otherwise(0.0).alias("val"))


def jacobi(edges: DataFrame, b: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """One damped sweep: x + D (b - L x), with D half the inverse degrees; without x it is D b."""
    scale = inverse_diagonal(edges).withColumnRenamed("val", "_d")
    if x is None:
        return b.join(scale, "id", "left").select("id", (F.coalesce("_d", F.lit(0.0)) * F.col("val")).alias("val"))
    y = matvec(edges, x).withColumnRenamed("val", "_y")
    rows = b.withColumnRenamed("val", "_b").join(x, "id").join(y, "id").join(scale, "id", "left")
    return rows.select("id", (F.col("val") + F.coalesce("_d", F.lit(0.0)) * (F.col("_b") - F.col("_y"))).alias("val"))


def restrict(fine: DataFrame, labels: DataFrame) -> DataFrame:
    """Sums by label; ids without a label drop out."""
    return fine.join(labels, "id").groupBy(F.col("label").alias("id")).agg(F.sum("val").alias("val"))


def prolong(coarse: DataFrame, labels: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """Each id's coarse value; with onto, added to it (ids without a label keep theirs)."""
    spread = labels.join(coarse.select(F.col("id").alias("label"), F.col("val").alias("_c")), "label").select("id", "_c")
    if onto is None:
        return spread.withColumnRenamed("_c", "val")
    return onto.join(spread, "id", "left").select("id", (F.col("val") + F.coalesce("_c", F.lit(0.0))).alias("val"))


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph between labels: weights of edges between two labels are summed, edges inside one vanish."""
    a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "uv")
    moved = edges.join(a, "u").join(b, "v").filter("lu <> lv")
    return moved.groupBy(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).agg(F.sum("w").alias("w"))


def label_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def component_sums(x: DataFrame, components: DataFrame) -> DataFrame:
    return x.join(components, "id").groupBy("component").agg(F.sum("val").alias("total"), F.sum(F.abs("val")).alias("scale"), F.count(F.lit(1)).alias("size"))


def center(x: DataFrame, components: DataFrame) -> DataFrame:
    """x less its mean over each component: sums first, then a join of one row a component."""
    means = component_sums(x, components).select("component", (F.col("total") / F.col("size")).alias("_m"))
    return x.join(components, "id").join(means, "component").select("id", (F.col("val") - F.col("_m")).alias("val"))


def project_rhs(b: DataFrame, components: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """b without its component means; what rounding leaves goes to the id with the smallest value. Fails at a component whose sum is not small."""
    sums = component_sums(b, components)
    bad = F.abs("total") > tolerance * F.greatest(F.lit(1.0), "scale")
    means = sums.select("component", F.coalesce(_refuse(bad, "IncompatibleRhs: component", "component", "total"), F.col("total") / F.col("size")).alias("_m"))
    flat = b.join(components, "id").join(means, "component").select("id", "component", (F.col("val") - F.col("_m")).alias("val"))
    rest = flat.groupBy("component").agg(F.sum("val").alias("_rest"), F.min(F.struct(F.abs("val").alias("a"), F.col("id").alias("i"))).alias("_at"))
    return flat.join(rest, "component").select("id", (F.col("val") - F.when(F.col("id") == F.col("_at.i"), F.col("_rest")).otherwise(0.0)).alias("val"))


def heavy_edges(edges: DataFrame) -> DataFrame:
    """(id, parent, weight): each vertex's neighbour by its heaviest edge, the smallest among equals."""
    best = F.max(F.struct("w", (-F.col("nbr")).alias("n")))
    return both(edges).groupBy("id").agg(best.alias("b")).select("id", (-F.col("b.n")).alias("parent"), F.col("b.w").alias("weight"))


def low_degree_cuts(edges: DataFrame, heavy: DataFrame, parents: DataFrame, threshold: float) -> DataFrame:
    """parents(id, parent) with weakly held vertices made roots: none unless some heavy edge is below threshold * degree;
    then those whose tree edges, each counted at both ends, are."""
    d = degrees(edges).select("id", "degree")
    moved = parents.filter("id <> parent").join(heavy.select("id", "weight"), "id")
    tree = moved.select("id", "weight").unionByName(moved.select(F.col("parent").alias("id"), "weight")).groupBy("id").agg(F.sum("weight").alias("tree"))
    weak = heavy.join(d, "id").filter(F.col("weight") < threshold * F.col("degree")).limit(1).select(F.lit(True).alias("_any"))
    rows = parents.join(d, "id", "left").join(tree, "id", "left").crossJoin(F.broadcast(weak.agg(F.count(F.lit(1)).alias("_weak"))))
    cut = (F.col("_weak") > 0) & (F.col("degree") > 0) & (F.coalesce("tree", F.lit(0.0)) < threshold * F.col("degree"))
    return rows.select("id", F.when(cut, F.col("id")).otherwise(F.col("parent")).alias("parent"))


def dense_ids(rows: DataFrame, column: str = "id") -> DataFrame:
    """(column, index): indices 0, 1, ... by value, without a global window: counts of range partitions, then offsets.

    Rows are written with their partition and place once, so both readers see the same ones whatever is run again.
    """
    ids = rows.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).select(column, F.monotonically_increasing_id().alias("_k"))
    ids = written(ids, "numbered").select(column, F.shiftright("_k", 33).alias("_p"), F.col("_k").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"))
    counts = ids.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return ids.join(F.broadcast(offsets), "_p").select(column, (F.col("_o") + F.col("_k")).cast("long").alias("index"))


def prune_isolates(labels: DataFrame, coarse_edges: DataFrame) -> DataFrame:
    """Labels renumbered over the coarse vertices that have edges; vertices of isolated ones drop out."""
    kept = dense_ids(coarse_edges.select(F.explode(F.array("u", "v")).alias("label")), "label")
    return labels.join(kept, "label").select("id", F.col("index").alias("label"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    return edges.join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(ids.select(F.col("id").alias("v")), "v", "left_semi").select(edges.columns)


def row_offsets(edges: DataFrame) -> DataFrame:
    """(id, offset, links): where each vertex's entries begin when all are stored by row."""
    d = degrees(edges).select("id", "links")
    ids = dense_ids(d)
    placed = d.join(ids, "id").withColumn("_b", F.floor(F.col("index") / 4096))
    inside = Window.partitionBy("_b").orderBy("index")
    blocks = placed.groupBy("_b").agg(F.sum("links").alias("_t"))
    before = blocks.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
    return placed.join(before, "_b").select("id", (F.col("_before") + F.sum("links").over(inside) - F.col("links")).alias("offset"), "links")


def degree_histogram(edges: DataFrame, bounds: tuple[int, ...] = (1, 2, 3, 5, 9, 17, 33)) -> DataFrame:
    """(low, high, vertices): vertices by number of links; the last bin's high is 0, for no upper end."""
    low = high = F.lit(None).cast("int")
    for a, b in zip(bounds, (*(x - 1 for x in bounds[1:]), 0), strict=True):
        low = F.when(F.col("links") >= a, F.lit(a)).otherwise(low)
        high = F.when(F.col("links") >= a, F.lit(b)).otherwise(high)
    return degrees(edges).select(low.alias("low"), high.alias("high")).groupBy("low", "high").agg(F.count(F.lit(1)).alias("vertices"))


def pack(edges: DataFrame) -> DataFrame:
    """key: both endpoints in one long, and back."""
    key = F.shiftleft("u", 32).bitwiseOR(F.col("v"))
    return edges.select(key.alias("key"), F.shiftrightunsigned(key, 32).alias("u"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("v"), "w")


def laplacian_entries(edges: DataFrame) -> DataFrame:
    """(i, j, value) of the Laplacian's stored entries."""
    off = both(edges).select(F.col("id").alias("i"), F.col("nbr").alias("j"), (-F.col("w")).alias("value"))
    return off.unionByName(degrees(edges).select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("degree").alias("value")))


def prepared(pairs: DataFrame) -> DataFrame:
    """A fixed topology: (input_idx, u, v) with edge_idx, the index of the unordered pair among all of them."""
    p = pairs.select("input_idx", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    index = dense_ids(p.select(F.struct("u", "v").alias("pair")), "pair").select(F.col("pair.u").alias("u"), F.col("pair.v").alias("v"), F.col("index").alias("edge_idx"))
    return p.join(index, ["u", "v"])


def assemble(topology: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, u, v, edge_idx, w) from weights (frame, input_idx, w) over a prepared topology."""
    return frames.join(topology, "input_idx").groupBy("frame", "edge_idx", "u", "v").agg(F.sum("w").alias("w"))
