"""The registered queries of the library, and SQL that gives the same rows.

The graph of most queries joins suppliers and orders by line items; quantities are whole numbers, so sums
of them and of whole-numbered vectors are exact in any order. Other doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sums
from ..operators import benchlab, panel, sddm, solve
from ..operators import graph as G
from ..operators.components import components, written
from ..options import EngineOptions, HierarchyOptions, PcgOptions
from ..sources import generators as gen
from ..sources.tables import ORDERS_FROM, bipartite, order_supplier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query under its name, with SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


RAW = f"raw AS (SELECT l_suppkey AS u, l_orderkey + {ORDERS_FROM} AS v, l_quantity AS w FROM lineitem)"
E = f"{RAW}, e AS (SELECT u, v, sum(w) AS w FROM raw GROUP BY u, v)"
B = f"{E}, b AS (SELECT u AS id, v AS nbr, w FROM e UNION ALL SELECT v, u, w FROM e)"
D = f"{B}, d AS (SELECT id, sum(w) AS degree, count(*) AS links FROM b GROUP BY id)"
X = f"{D}, x AS (SELECT id, CAST((17 * id) % 257 - 128 AS DOUBLE) AS val FROM d)"
Y = f"{X}, y AS (SELECT b.id, sum(b.w * (x.val - n.val)) AS val FROM b JOIN x ON x.id = b.id JOIN x n ON n.id = b.nbr GROUP BY b.id)"
L = f"{X}, l AS (SELECT id, id % 97 AS label FROM d)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical(order_supplier(spark, sf_dir))


def vertices(e: DataFrame) -> DataFrame:
    return G.degrees(e).select("id")


def vector(ids: DataFrame) -> DataFrame:
    """A whole-numbered value for each id."""
    return ids.select("id", ((F.col("id") * 17) % 257 - 128).cast("double").alias("val"))


def residues(ids: DataFrame, k: int = 97) -> DataFrame:
    return ids.select("id", (F.col("id") % k).alias("label"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"WITH {E} SELECT * FROM e")
def graph_canonical(spark, sf_dir):
    return G.canonical(order_supplier(spark, sf_dir), exact=True)


@query(f"WITH {D} SELECT count(*) AS vertex_count, CAST(sum(links) // 2 AS BIGINT) AS edge_count, CAST(count(*) + sum(links) AS BIGINT) AS matrix_nnz, 2 * max(degree) AS norm_bound FROM d")
def graph_metadata(spark, sf_dir):
    return G.metadata(edges(spark, sf_dir))


@query(f"WITH {D} SELECT id, degree, links FROM d")
def degree(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query(f"WITH {B} SELECT * FROM b")
def symmetrize(spark, sf_dir):
    return G.both(edges(spark, sf_dir))


@query(f"WITH {E} SELECT (u << 32) | v AS key, u, v, w FROM e")
def edge_key(spark, sf_dir):
    return G.pack(edges(spark, sf_dir))


@query(f"WITH {RAW} SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY v, w) AS place FROM raw")
def edge_sort(spark, sf_dir):
    """The raw edges in canonical order within each first endpoint."""
    order = Window.partitionBy("u").orderBy("v", "w")
    return order_supplier(spark, sf_dir).withColumn("place", F.row_number().over(order).cast("long"))


@query(f"WITH {D} SELECT id, CASE WHEN degree > 0 THEN 0.5 / degree ELSE 0 END AS val FROM d")
def jacobi_diag(spark, sf_dir):
    return G.inverse_diagonal(edges(spark, sf_dir))


@query(f"WITH {Y} SELECT * FROM y")
def matvec(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.matvec(e, vector(vertices(e)))


@query(f"WITH {X} SELECT sum(e.w * (a.val - c.val) * (a.val - c.val)) AS energy FROM e JOIN x a ON a.id = e.u JOIN x c ON c.id = e.v")
def energy(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.energy(e, vector(vertices(e)))


@query(f"WITH {X} SELECT sum(val * val) AS dot FROM x")
def dot(spark, sf_dir):
    """A dot product with the same bits from any partitioning."""
    x = vector(vertices(edges(spark, sf_dir)))
    return sums.ordered_sum(x, "id", F.col("val") * F.col("val")).select(F.col("total").alias("dot"))


@query(f"WITH {X} SELECT round(sqrt(sum(val * val)), 6) AS norm FROM x")
def norm2(spark, sf_dir):
    return sums.norm2(vector(vertices(edges(spark, sf_dir)))).select(F.round("norm", 6).alias("norm"))


@query("SELECT l_suppkey AS id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY 1")
def compsum(spark, sf_dir):
    """Compensated sums of values in ascending order, by group."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    chunks = t.groupBy("id", F.pmod(F.xxhash64("x"), F.lit(64)).alias("k")).agg(F.array_sort(F.collect_list("x")).alias("v")).select("id", sums.compensated(F.col("v")).alias("s"))
    return chunks.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("v")).select("id", F.round(sums.compensated(F.col("v")), 2).alias("total"))


@query(f"WITH {L} SELECT l.label AS id, sum(x.val) AS val FROM x JOIN l USING (id) GROUP BY 1")
def restrict(spark, sf_dir):
    v = vertices(edges(spark, sf_dir))
    return G.restrict(vector(v), residues(v))


@query(f"WITH {L}, c AS (SELECT label, CAST((17 * label) % 257 - 128 AS DOUBLE) AS c FROM (SELECT DISTINCT label FROM l)) SELECT x.id, x.val + c.c AS val FROM x JOIN l USING (id) JOIN c USING (label)")
def prolong(spark, sf_dir):
    v = vertices(edges(spark, sf_dir))
    coarse = vector(residues(v).select(F.col("label").alias("id")).distinct())
    return G.prolong(coarse, residues(v), vector(v))


@query(f"WITH {L} SELECT least(a.label, c.label) AS u, greatest(a.label, c.label) AS v, sum(e.w) AS w FROM e JOIN l a ON a.id = e.u JOIN l c ON c.id = e.v WHERE a.label <> c.label GROUP BY 1, 2")
def contract(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.contract(e, residues(vertices(e)))


@query(f"WITH {L} SELECT label, count(*) AS size FROM l GROUP BY label")
def aggregate_sizes(spark, sf_dir):
    return G.label_sizes(residues(vertices(edges(spark, sf_dir))))


@query(f"WITH {L}, p AS (SELECT id, label FROM l WHERE label % 3 <> 0) SELECT p.label AS id, sum(x.val) AS val FROM x JOIN p USING (id) GROUP BY 1")
def pruned_transfer(spark, sf_dir):
    """Restriction by labels that some vertices lack."""
    v = vertices(edges(spark, sf_dir))
    return G.restrict(vector(v), residues(v).filter("label % 3 <> 0"))


@query(
    f"WITH {L}, s AS (SELECT id, id % 5000 AS label FROM d), c AS (SELECT DISTINCT a.label AS lu, z.label AS lv FROM e JOIN s a ON a.id = e.u JOIN s z ON z.id = e.v WHERE a.label <> z.label AND a.label % 7 <> 0 AND z.label % 7 <> 0), "
    "k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS n FROM (SELECT lu AS label FROM c UNION SELECT lv FROM c)) SELECT s.id, k.n AS label FROM s JOIN k USING (label)"
)
def prune_isolates(spark, sf_dir):
    e = edges(spark, sf_dir)
    labels = residues(vertices(e), 5000)
    coarse = G.contract(e, labels).filter("u % 7 <> 0 AND v % 7 <> 0")
    return G.prune_isolates(labels, coarse)


@query(f"WITH {D} SELECT id, CAST(sum(links) OVER (ORDER BY id) - links AS BIGINT) AS \"offset\", links FROM d")
def row_offsets(spark, sf_dir):
    return G.row_offsets(edges(spark, sf_dir))


@query(f"WITH {B}, r AS (SELECT id, nbr, w, row_number() OVER (PARTITION BY id ORDER BY w DESC, nbr) AS k FROM b) SELECT id, nbr AS parent, w AS weight FROM r WHERE k = 1")
def heavy_forest(spark, sf_dir):
    return G.heavy_edges(edges(spark, sf_dir))


FOREST = "f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE o_orderkey // 2 END AS parent FROM orders)"
WALK = f"RECURSIVE {FOREST}, r AS (SELECT id, parent AS up FROM f UNION SELECT r.id, f.parent FROM r JOIN f ON f.id = r.up WHERE f.parent <> r.up)"


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 == 0, k).otherwise(F.floor(k / 2)).alias("parent"))


@query(f"WITH {WALK} SELECT id, min(up) AS component FROM r GROUP BY id")
def forest_components(spark, sf_dir):
    return components(forest(spark, sf_dir), "id", "parent")


@query(f"WITH {WALK}, c AS (SELECT id, min(up) AS component FROM r GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size, dense_rank() OVER (ORDER BY component) - 1 AS label FROM c")
def components_labels(spark, sf_dir):
    """Components with sizes, and labels in the order of their smallest ids."""
    c = written(components(forest(spark, sf_dir), "id", "parent"), "components")
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(G.dense_ids(c, "component"), "component")
    return c.join(sizes, "component").select("id", "component", "size", F.col("index").alias("label"))


CX = f"{WALK}, c AS (SELECT id, min(up) AS component FROM r GROUP BY id), x AS (SELECT id, CAST((17 * id) % 257 - 128 AS DOUBLE) AS val FROM f)"


@query(f"WITH {CX} SELECT component, sum(val) AS total, sum(abs(val)) AS scale, count(*) AS size FROM c JOIN x USING (id) GROUP BY component")
def component_sums(spark, sf_dir):
    f = forest(spark, sf_dir)
    return G.component_sums(vector(f.select("id")), components(f, "id", "parent"))


@query(f"WITH {CX} SELECT id, round(val - avg(val) OVER (PARTITION BY component), 6) AS val FROM c JOIN x USING (id)")
def center(spark, sf_dir):
    f = forest(spark, sf_dir)
    return G.center(vector(f.select("id")), components(f, "id", "parent")).select("id", F.round("val", 6).alias("val"))


@query(f"WITH {CX} SELECT id, round(val - avg(val) OVER (PARTITION BY component), 6) AS val FROM c JOIN x USING (id)")
def project_rhs(spark, sf_dir):
    """The projection with a tolerance that admits any sum; its correction of rounding is below the digits shown."""
    f = forest(spark, sf_dir)
    return G.project_rhs(vector(f.select("id")), components(f, "id", "parent"), 1e9).select("id", F.round("val", 6).alias("val"))


@query(f"WITH {WALK}, c AS (SELECT id, min(up) AS component FROM r GROUP BY id), s AS (SELECT component, count(*) AS n FROM c GROUP BY 1), t AS (SELECT component FROM s ORDER BY n DESC, component LIMIT 1) SELECT f.parent AS u, f.id AS v FROM f JOIN c USING (id) JOIN t USING (component) WHERE f.id <> f.parent")
def largest_component(spark, sf_dir):
    from ..sources.tables import largest_component as largest

    f = forest(spark, sf_dir).filter("id <> parent").select(F.col("parent").alias("u"), F.col("id").alias("v"))
    return largest(f)


@query(f"WITH {D} SELECT low, high, count(*) AS vertices FROM (SELECT CASE WHEN links >= 33 THEN 33 WHEN links >= 17 THEN 17 WHEN links >= 9 THEN 9 WHEN links >= 5 THEN 5 WHEN links >= 3 THEN 3 WHEN links >= 2 THEN 2 ELSE 1 END AS low, CASE WHEN links >= 33 THEN 0 WHEN links >= 17 THEN 32 WHEN links >= 9 THEN 16 WHEN links >= 5 THEN 8 WHEN links >= 3 THEN 4 WHEN links >= 2 THEN 2 ELSE 1 END AS high FROM d) GROUP BY 1, 2")
def degree_histogram(spark, sf_dir):
    return G.degree_histogram(edges(spark, sf_dir))


@query(f"WITH {D}, k AS (SELECT id FROM d WHERE links % 3 <> 0) SELECT e.* FROM e WHERE u IN (SELECT id FROM k) AND v IN (SELECT id FROM k)")
def induced_subgraph(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.induced(e, G.degrees(e).filter("links % 3 <> 0"))


@query(f"WITH {D} SELECT id AS i, id AS j, degree AS value FROM d UNION ALL SELECT id, nbr, -w FROM b")
def laplacian_entries(spark, sf_dir):
    return G.laplacian_entries(edges(spark, sf_dir))


@query("WITH e AS (SELECT s_nationkey % 5 AS u, 5 + s_suppkey % 4 AS v, count(*) AS w FROM supplier GROUP BY 1, 2), b AS (SELECT u AS i, v AS j, w FROM e UNION ALL SELECT v, u, w FROM e), a AS (SELECT i, j, -w AS x FROM b UNION ALL SELECT i, i, sum(w) FROM b GROUP BY i) SELECT CAST(i AS BIGINT) AS i, " + ", ".join(f"CAST(coalesce(sum(x) FILTER (j = {k}), 0) AS DOUBLE) AS c{k}" for k in range(9)) + " FROM a GROUP BY i")
def dense_laplacian(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("u"), (F.col("s_suppkey") % 4 + 5).alias("v"), F.lit(1.0).alias("w"))
    wide = G.laplacian_entries(G.canonical(t)).groupBy("i").pivot("j", list(range(9))).agg(F.sum("value"))
    return wide.select("i", *(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(f"c{k}") for k in range(9)))


PAIRS = f"p AS (SELECT l_orderkey * 10 + l_linenumber AS input_idx, l_suppkey AS u, l_orderkey + {ORDERS_FROM} AS v FROM lineitem), t AS (SELECT *, dense_rank() OVER (ORDER BY u, v) - 1 AS edge_idx FROM p)"


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return G.prepared(t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("input_idx"), F.col("l_suppkey").alias("u"), (F.col("l_orderkey") + ORDERS_FROM).alias("v")))


@query(f"WITH {PAIRS} SELECT input_idx, u, v, edge_idx FROM t")
def prepared_map(spark, sf_dir):
    return topology(spark, sf_dir).select("input_idx", "u", "v", "edge_idx")


@query(f"WITH {PAIRS}, f AS (SELECT frame, input_idx, CAST((input_idx + frame) % 7 + 1 AS DOUBLE) AS w FROM (SELECT l_orderkey * 10 + l_linenumber AS input_idx FROM lineitem), range(3) r(frame)) SELECT CAST(frame AS INT) AS frame, u, v, edge_idx, sum(w) AS w FROM f JOIN t USING (input_idx) GROUP BY ALL")
def prepared_frames(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("input_idx"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame"))
    return G.assemble(topology(spark, sf_dir), t.withColumn("w", ((F.col("input_idx") + F.col("frame")) % 7 + 1).cast("double")))


@query(f"WITH {Y}, s AS (SELECT id, CAST((13 * id) % 101 - 50 AS DOUBLE) AS g FROM d) SELECT x.id, round(x.val + 0.5 / d.degree * (s.g - y.val), 6) AS val FROM x JOIN y USING (id) JOIN s USING (id) JOIN d USING (id)")
def jacobi_sweep(spark, sf_dir):
    e = edges(spark, sf_dir)
    v = vertices(e)
    b = v.select("id", ((F.col("id") * 13) % 101 - 50).cast("double").alias("val"))
    return G.jacobi(e, b, vector(v)).select("id", F.round("val", 6).alias("val"))


@query(f"WITH {D}, w AS (SELECT id, (SELECT count(*) FROM b z WHERE false) AS n FROM d) SELECT id, id AS parent FROM w WHERE false UNION ALL SELECT h.id, CASE WHEN h.low AND h.tree < 0.125 * h.degree THEN h.id ELSE h.parent END FROM (WITH r AS (SELECT id, nbr, w, row_number() OVER (PARTITION BY id ORDER BY w DESC, nbr) AS k FROM b), p AS (SELECT id, nbr AS parent, w AS weight FROM r WHERE k = 1), t AS (SELECT id, sum(weight) AS tree FROM (SELECT id, weight FROM p UNION ALL SELECT parent, weight FROM p) GROUP BY id) SELECT p.id, p.parent, t.tree, d.degree, (SELECT count(*) > 0 FROM p q JOIN d e ON e.id = q.id WHERE q.weight < 0.125 * e.degree) AS low FROM p JOIN t USING (id) JOIN d USING (id)) h")
def low_degree(spark, sf_dir):
    """Cuts of weakly held vertices, on the heavy forest as it is."""
    e = edges(spark, sf_dir)
    heavy = G.heavy_edges(e)
    return G.low_degree_cuts(e, heavy, heavy.select("id", "parent"), 0.125)


@query()
def split_forest(spark, sf_dir):
    e = edges(spark, sf_dir)
    heavy = written(G.heavy_edges(e).select("id", "parent"), "heavy")
    return solve.split_parents(heavy, written(components(heavy, "id", "parent"), "trees"))


@query()
def forest_grouping(spark, sf_dir):
    return solve.grouping(edges(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + ORDERS_FROM).alias("v"), F.col("l_quantity").alias("w"))
    return G.canonical(t)


@query()
def hierarchy_report(spark, sf_dir):
    return solve.hierarchy_levels(parts(spark, sf_dir), HierarchyOptions(direct_threshold=50))


@query()
def pruned_hierarchy(spark, sf_dir):
    """Isolated coarse vertices retired: a path of 4096 and 1000 pairs."""
    e, ids = gen.disconnected(spark, 4096, 1000)
    g, _ = solve.local_graph(e, ids=ids)
    return solve.hierarchy_tables(spark, solve.Hierarchy.build(g, HierarchyOptions(prune=True)))[0]


# Generated families: they read no table, and n is fixed.
GRID = "g AS (SELECT i, CAST(ceil(sqrt(2000)) AS BIGINT) AS k FROM range(2000) r(i))"
WEIGHT = "0.5 + ((({s}) % 1024) * 1103515245 + 12345) % 1024 / 512.0"


@query(f"SELECT i AS u, i + 1 AS v, {WEIGHT.format(s='i')} AS w FROM range(1999) r(i)")
def gen_path(spark, sf_dir):
    return gen.path(spark, 2000)


@query(f"WITH {GRID} SELECT i AS u, i + 1 AS v, {WEIGHT.format(s='i')} AS w FROM g WHERE i % k + 1 < k AND i + 1 < 2000 UNION ALL SELECT i, i + k, {WEIGHT.format(s='i * 31')} FROM g WHERE i + k < 2000")
def gen_grid(spark, sf_dir):
    return gen.grid(spark, 2000)


WF = "SELECT i AS u, 1000 + CASE k WHEN 0 THEN i % 1000 WHEN 1 THEN (i + 1) % 1000 ELSE ((2 * k + 1) * i + 17 * k + 3) % 1000 END AS v, 0.25 + ((i + 7 * k) % 23) / 16.0 AS w FROM range(1000) a(i), range({n}) b(k)"


@query(WF.format(n=3))
def gen_worker_firm(spark, sf_dir):
    return gen.worker_firm(spark, 2000)


@query(WF.format(n=16))
def gen_dense(spark, sf_dir):
    return gen.worker_firm(spark, 2000, 16)


@query(f"WITH c AS (SELECT k, k * 2000 // 16 AS a, (k + 1) * 2000 // 16 AS z FROM range(16) r(k)), g AS (SELECT a, z - a AS n, CAST(ceil(sqrt(z - a)) AS BIGINT) AS q, i FROM c, range(125) r(i) WHERE i < z - a) SELECT a + i AS u, a + i + 1 AS v, {WEIGHT.format(s='a + i')} AS w FROM g WHERE i % q + 1 < q AND i + 1 < n UNION ALL SELECT a + i, a + i + q, {WEIGHT.format(s='(a + i) * 31')} FROM g WHERE i + q < n UNION ALL SELECT a - 1, a, 1.0 FROM c WHERE k > 0")
def gen_community(spark, sf_dir):
    return gen.weak_community(spark, 2000)


TRUTH = "t AS (SELECT r AS rhs_id, i AS id, ((i * 17 + r * 31) % 257 - 128) / 37.0 + ((i * 43 + r * 19) % 101 - 50) / 113.0 AS val FROM range(2000) a(i), range(3) b(r)), c AS (SELECT rhs_id, id, val - avg(val) OVER (PARTITION BY rhs_id) AS val FROM t)"


def wave(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A grid, and right-hand sides with known solutions."""
    e = G.canonical(gen.grid(spark, 2000))
    x = gen.truth(spark, 2000, 3)
    pairs = G.both(e).join(x.select("rhs_id", F.col("id").alias("nbr"), F.col("val").alias("n")), "nbr").groupBy("rhs_id", "id").agg(F.sum("w").alias("d"), F.sum(F.col("w") * F.col("n")).alias("s"))
    return e, pairs.join(x, ["rhs_id", "id"]).select("rhs_id", "id", (F.col("d") * F.col("val") - F.col("s")).alias("val"))


GE = f"{GRID}, e AS (SELECT i AS u, i + 1 AS v, {WEIGHT.format(s='i')} AS w FROM g WHERE i % k + 1 < k AND i + 1 < 2000 UNION ALL SELECT i, i + k, {WEIGHT.format(s='i * 31')} FROM g WHERE i + k < 2000), b AS (SELECT u AS id, v AS nbr, w FROM e UNION ALL SELECT v, u, w FROM e), {TRUTH}"


@query(f"WITH {GE} SELECT CAST(c.rhs_id AS INT) AS rhs_id, c.id, round(sum(b.w * (c.val - n.val)), 6) AS val FROM b JOIN c ON c.id = b.id JOIN c n ON n.id = b.nbr AND n.rhs_id = c.rhs_id GROUP BY 1, 2")
def gen_rhs(spark, sf_dir):
    return wave(spark)[1].select("rhs_id", "id", F.round("val", 6).alias("val"))


TIGHT = PcgOptions(relative=1e-13)


@query(f"WITH {TRUTH} SELECT CAST(rhs_id AS INT) AS rhs_id, id, round(val, 5) AS val FROM c")
def pcg_batch(spark, sf_dir):
    """Several right-hand sides of one grid, a task for each, against the known solutions."""
    e, b = wave(spark)
    return solve.solutions(solve.solve_batch(e, b, TIGHT)).select(F.col("rhs_id").cast("int").alias("rhs_id"), "id", F.round("val", 5).alias("val"))


@query(f"WITH {TRUTH} SELECT id, round(val, 5) AS val FROM c WHERE rhs_id = 0")
def pcg_solve(spark, sf_dir):
    e, b = wave(spark)
    return solve.solutions(solve.solve_batch(e, b.filter("rhs_id = 0"), TIGHT)).select("id", F.round("val", 5).alias("val"))


@query(f"WITH {TRUTH} SELECT id, round(val, 5) AS val FROM c WHERE rhs_id = 1")
def retained_precond(spark, sf_dir):
    """The preconditioner of other weights on the same topology."""
    e, b = wave(spark)
    old = e.withColumn("w", F.col("w") * (1 + (F.col("u") % 3) / 10))
    return solve.solutions(solve.solve_batch(e, b.filter("rhs_id = 1"), TIGHT, retained=old)).select("id", F.round("val", 5).alias("val"))


@query("SELECT CAST(r AS BIGINT) AS rhs_id, true AS certified, 2000 AS n FROM range(3) a(r)")
def solve_metrics(spark, sf_dir):
    """Residuals computed afresh from the delivered solutions. Certificate only: values are compared in pcg_batch."""
    e, b = wave(spark)
    x = written(solve.solutions(solve.solve_batch(e, b)), "solutions")
    sums_ = G.both(e).join(x.select("rhs_id", F.col("id").alias("nbr"), F.col("val").alias("n")), "nbr").groupBy("rhs_id", "id").agg(F.sum("w").alias("d"), F.sum(F.col("w") * F.col("n")).alias("s"))
    r = sums_.join(x, ["rhs_id", "id"]).join(b.withColumnRenamed("val", "b"), ["rhs_id", "id"]).withColumn("r", F.col("b") - F.col("d") * F.col("val") + F.col("s"))
    bound = G.metadata(e).select("norm_bound")
    m = r.groupBy("rhs_id").agg(F.sqrt(F.sum(F.col("r") ** 2)).alias("r"), F.sqrt(F.sum(F.col("b") ** 2)).alias("b"), F.sqrt(F.sum(F.col("val") ** 2)).alias("x"), F.count(F.lit(1)).cast("int").alias("n"))
    return m.crossJoin(F.broadcast(bound)).select("rhs_id", (F.col("r") / (F.col("b") + F.col("norm_bound") * F.col("x")) <= 1.1e-8).alias("certified"), "n")


@query("WITH e AS (SELECT i, CASE WHEN i = 31 THEN 1.0 / 16777216 ELSE 1.0 END AS w FROM range(63) r(i)), p AS (SELECT i AS id, coalesce((SELECT sum(1 / w) FROM e WHERE e.i >= r.i), 0) AS x FROM range(64) r(i)) SELECT id, round(x - avg(x) OVER (), 4) AS val FROM p")
def bridge_oracle(spark, sf_dir):
    """A path with one edge of 2^-24: a current from end to end; potentials are cumulative resistances."""
    e = gen.path(spark, 64).withColumn("w", F.when(F.col("u") == 31, 2.0**-24).otherwise(1.0))
    b = spark.range(64).select(F.lit(0).alias("rhs_id"), "id", F.when(F.col("id") == 0, 1.0).when(F.col("id") == 63, -1.0).otherwise(0.0).alias("val"))
    x = solve.solutions(solve.solve_batch(e, b, PcgOptions(relative=0, absolute=1e-13), HierarchyOptions(direct_threshold=65)))
    return x.withColumn("m", F.avg("val").over(Window.partitionBy("rhs_id"))).select("id", F.round(F.col("val") - F.col("m"), 4).alias("val"))


@query("SELECT i AS id, round((x - avg(x) OVER ()) / 50, 6) AS val FROM (SELECT i, CAST((17 * i) % 257 - 128 AS DOUBLE) AS x FROM range(50) r(i))")
def adversarial(spark, sf_dir):
    """A complete graph of unit weights: x = (b - mean) / n."""
    v = vector(spark.range(50))
    b = v.crossJoin(F.broadcast(v.agg(F.avg("val").alias("m")))).select(F.lit(0).alias("rhs_id"), "id", (F.col("val") - F.col("m")).alias("val"))
    return solve.solutions(solve.solve_batch(gen.complete(spark, 50), b, TIGHT)).select("id", F.round("val", 6).alias("val"))


@query(f"WITH {X} SELECT id, round(val - avg(val) OVER (), 5) AS val FROM x")
def solve_distributed(spark, sf_dir):
    """Conjugate gradients where every vector stays a DataFrame, on the whole table's graph, which is connected."""
    e = written(edges(spark, sf_dir), "edges")
    b = written(G.matvec(e, vector(vertices(e))), "rhs")
    return solve.solve_distributed(e, b, PcgOptions(relative=1e-12))[0].select("id", F.round("val", 5).alias("val"))


SD = f"{D}, diag AS (SELECT id AS i, degree + id % 3 AS d FROM d), x AS (SELECT id, CAST((17 * id) % 257 - 128 AS DOUBLE) AS val FROM d)"


def matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, sf_dir)
    return G.degrees(e).select(F.col("id").alias("i"), (F.col("degree") + F.col("id") % 3).alias("d")), e.select(F.col("u").alias("i"), F.col("v").alias("j"), (-F.col("w")).alias("a"))


@query("SELECT id, round(val, 5) AS val FROM (SELECT i AS id, CAST((17 * i) % 257 - 128 AS DOUBLE) AS val FROM range(64) r(i))")
def sddm_solve(spark, sf_dir):
    """A path matrix with more than its off-diagonals on the diagonal, through one more vertex."""
    diag = spark.range(64).select(F.col("id").alias("i"), F.when(F.col("id").isin(0, 63), 1.25).otherwise(2.25).alias("d"))
    off = spark.range(63).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(-1.0).alias("a"))
    b = sddm.lift(sddm.matvec(diag, off, vector(spark.range(64))), 64).select(F.lit(0).alias("rhs_id"), "id", "val")
    x = solve.solutions(solve.solve_batch(sddm.augment(diag, off, 64), b, TIGHT, HierarchyOptions(direct_threshold=2)))
    return sddm.extract(x.select("id", "val"), 64).select("id", F.round("val", 5).alias("val"))


@query(f"WITH {SD} SELECT i, d, degree AS held, d - degree AS excess FROM diag JOIN d ON d.id = diag.i")
def sddm_canonical(spark, sf_dir):
    diag, off = matrix(spark, sf_dir)
    half = off.withColumn("a", F.col("a") / 2)
    mirrored = half.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")
    return sddm.excess(*sddm.canonical(diag, half.unionByName(mirrored).unionByName(off.withColumn("a", F.lit(0.0)))))


@query(f"WITH {SD} SELECT u, v, w FROM e UNION ALL SELECT i, {2 * ORDERS_FROM}, d - degree FROM diag JOIN d ON d.id = diag.i WHERE d > degree")
def sddm_augment(spark, sf_dir):
    return sddm.augment(*matrix(spark, sf_dir), 2 * ORDERS_FROM)


@query(f"WITH {SD} SELECT x.id, diag.d * x.val - s.s AS val FROM x JOIN diag ON diag.i = x.id JOIN (SELECT b.id, sum(b.w * x.val) AS s FROM b JOIN x ON x.id = b.nbr GROUP BY b.id) s ON s.id = x.id")
def sddm_matvec(spark, sf_dir):
    diag, off = matrix(spark, sf_dir)
    return sddm.matvec(diag, off, vector(diag.select(F.col("i").alias("id"))))


@query(f"WITH {X} SELECT id, val FROM x UNION ALL SELECT {2 * ORDERS_FROM}, -sum(val) FROM x")
def sddm_lift(spark, sf_dir):
    return sddm.lift(vector(vertices(edges(spark, sf_dir))), 2 * ORDERS_FROM)


@query("SELECT s_nationkey % 5 AS i, 5 + s_suppkey % 4 AS j, CAST(-count(*) AS DOUBLE) AS a FROM supplier GROUP BY 1, 2")
def sddm_dense(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).cast("long").alias("i"), (F.col("s_suppkey") % 4 + 5).alias("j")).agg((-F.count(F.lit(1))).cast("double").alias("value"))
    both_ = t.unionByName(t.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    diag = both_.groupBy("i").agg((-F.sum("value")).alias("value")).select("i", F.col("i").alias("j"), "value")
    return sddm.from_dense(both_.unionByName(diag))[1].select(F.col("i").cast("int").alias("i"), "j", "a")


# Panels: orders (a) meet suppliers (b).
PANEL = "p AS (SELECT l_orderkey * 10 + l_linenumber AS obs, l_orderkey AS a, l_suppkey AS b, l_quantity AS w, l_extendedprice AS y, l_discount AS x1, l_tax AS x2 FROM lineitem)"
CELLS = f"{PANEL}, c AS (SELECT a, b, sum(w) AS w FROM p GROUP BY a, b), k AS (SELECT a, count(*) AS degree, sum(w) AS total FROM c GROUP BY a)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs"), F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("x1"), F.col("l_tax").alias("x2"))


@query(f"WITH {CELLS} SELECT a, degree, total, degree <= 5 AS eliminated FROM k")
def schur_workers(spark, sf_dir):
    return panel.workers(panel.cells(lines(spark, sf_dir)))


@query(f"WITH {CELLS}, z AS (SELECT c.*, k.total, k.degree FROM c JOIN k USING (a)) SELECT 'clique' AS kind, p.b AS u, q.b AS v, round(sum(p.w * q.w / p.total), 6) AS w FROM z p JOIN z q ON p.a = q.a AND p.b < q.b WHERE p.degree <= 5 GROUP BY 2, 3 UNION ALL SELECT 'row', a, b, w FROM z WHERE degree > 5")
def schur_edges(spark, sf_dir):
    return panel.schur_edges(panel.cells(lines(spark, sf_dir))).select("kind", "u", "v", F.round("w", 6).alias("w"))


@query(f"WITH {PANEL}, m AS (SELECT sum(w * y) / sum(w) AS m FROM p) SELECT 'a' AS side, a AS level, round(sum(w * (y - m)) / 1000, 4) AS val FROM p, m GROUP BY 2 UNION ALL SELECT 'b', b, round(-sum(w * (y - m)) / 1000, 4) FROM p, m GROUP BY 2")
def fe_rhs(spark, sf_dir):
    return panel.rhs(lines(spark, sf_dir), "y").select("side", "level", F.round(F.col("val") / 1000, 4).alias("val"))


@query(f"WITH {CELLS}, m AS (SELECT sum(w * y) / sum(w) AS m FROM p), v AS (SELECT a, b, sum(w) AS w, sum(w * (y - m)) AS x FROM p, m GROUP BY a, b), t AS (SELECT v.*, k.total, k.degree, sum(x) OVER (PARTITION BY a) AS t FROM v JOIN k USING (a)) SELECT b AS level, round(sum(-x + CASE WHEN degree <= 5 THEN w / total * t ELSE 0 END), 2) AS val FROM t GROUP BY b")
def schur_rhs(spark, sf_dir):
    """What the eliminated levels leave for the other block."""
    p = lines(spark, sf_dir)
    mean = p.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    v = p.crossJoin(F.broadcast(mean)).groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * (F.col("y") - F.col("m"))).alias("x"))
    t = v.join(panel.workers(panel.cells(p)), "a").join(v.groupBy("a").agg(F.sum("x").alias("t")), "a")
    return t.groupBy(F.col("b").alias("level")).agg(F.round(F.sum(-F.col("x") + F.when(F.col("eliminated"), F.col("w") / F.col("total") * F.col("t")).otherwise(0.0)), 2).alias("val"))


@query(f"WITH {PANEL}, u AS (SELECT w, unnest([struct_pack(k := 'y', v := y), struct_pack(k := 'x1', v := x1), struct_pack(k := 'x2', v := x2)]) AS s FROM p), m AS (SELECT s.k AS k, max(abs(s.v)) AS top, sum(w * s.v) / sum(w) AS mean FROM u GROUP BY 1) SELECT m.k AS \"column\", round(top, 6) AS top, round(mean, 6) AS mean, round(sum(w * (s.v - mean) * (s.v - mean)) / 1000000, 3) AS square FROM u JOIN m ON u.s.k = m.k GROUP BY 1, 2, 3")
def fe_moments(spark, sf_dir):
    m = panel.moments(lines(spark, sf_dir), ["y", "x1", "x2"])
    return m.select("column", F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"), F.round(F.col("square") / 1e6, 3).alias("square"))


@query(f"WITH {PANEL}, t AS (SELECT *, w / (SELECT max(w) FROM p) AS s, y - avg(y) OVER (PARTITION BY a) AS r FROM p), q AS (SELECT sqrt(sum(s * (y - (SELECT sum(w * y) / sum(w) FROM p)) ** 2)) AS n FROM t), g AS (SELECT abs(sum(s * r)) / sqrt(sum(s)) AS m FROM t GROUP BY a UNION ALL SELECT abs(sum(s * r)) / sqrt(sum(s)) FROM t GROUP BY b) SELECT round(max(m) / any_value(n), 9) AS moment FROM g, q")
def fe_certificate(spark, sf_dir):
    """The certificate of a residual that is only half demeaned."""
    p = lines(spark, sf_dir).withColumn("r", F.col("y") - F.avg("y").over(Window.partitionBy("a")))
    return panel.certificate(p, "y", "r").select(F.round("moment", 9).alias("moment"))


PAIR = "v AS (SELECT user_id AS a, event_type AS t, avg(value) AS y FROM events GROUP BY 1, 2)"


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each user and kind of event."""
    t = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("a"), F.col("event_type").alias("t")).agg(F.avg("value").alias("y"))
    b = F.when(F.col("t") == "click", 0).when(F.col("t") == "error", 1).when(F.col("t") == "purchase", 2).when(F.col("t") == "signup", 3).otherwise(4)
    return t.select((F.col("a") * 10 + b).alias("obs"), "a", b.cast("long").alias("b"), F.lit(1.0).alias("w"), "y")


@query(f"WITH {PAIR}, n AS (SELECT a, t, y FROM v) SELECT a * 10 + CASE t WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS obs, round(y - avg(y) OVER (PARTITION BY a) - avg(y) OVER (PARTITION BY t) + avg(y) OVER (), 5) AS resid FROM n")
def fe_demean(spark, sf_dir):
    """Values less user and kind effects; every user meets every kind at the sizes tested, so the result has a closed form."""
    out, _ = panel.demean(balanced(spark, sf_dir), ["y"], 1e-10)
    return out.select("obs", F.round("y_resid", 5).alias("resid"))


@query("SELECT true AS certified, count(*) AS n FROM lineitem")
def fe_demean_lines(spark, sf_dir):
    """Prices less order and supplier effects, weighted: the moment recomputed from the residuals. Certificate only."""
    out, _ = panel.demean(lines(spark, sf_dir), ["y"])
    out = written(out, "residuals")
    return panel.certificate(out, "y", "y_resid").crossJoin(out.agg(F.count(F.lit(1)).alias("n"))).select((F.col("moment") <= 1e-8).alias("certified"), "n")


@query()
def schur_recover(spark, sf_dir):
    return panel.effects(lines(spark, sf_dir), ["y"])[0].select("column", "side", "level", F.round("effect", 4).alias("effect"))


@query("SELECT round(2.5, 6) AS x1, round(-4.0, 6) AS x2")
def fe_ols(spark, sf_dir):
    """Coefficients of an outcome made of two columns and both effects come back exactly."""
    p = lines(spark, sf_dir).withColumn("y", 2.5 * F.col("x1") - 4.0 * F.col("x2") + F.col("a") % 11 + F.col("b") % 7)
    out, _ = panel.demean(p, ["y", "x1", "x2"], 1e-10)
    c = panel.ols(out, "y_resid", ["x1_resid", "x2_resid"])
    return spark.createDataFrame([(round(float(c[0]), 6), round(float(c[1]), 6))], "x1 double, x2 double")


@query()
def fe_panel(spark, sf_dir):
    return gen.panel(spark, 2000)


MOVES = "o AS (SELECT o_custkey AS a, o_orderpriority AS f, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders)"


@query(f"WITH {MOVES}, c AS (SELECT a, max(CASE WHEN f <> was THEN 1 ELSE 0 END) AS ever FROM o GROUP BY a) SELECT round(avg(CASE WHEN was IS NOT NULL THEN CASE WHEN f <> was THEN 1.0 ELSE 0 END END), 9) AS move_share, (SELECT round(avg(ever), 9) FROM c) AS ever_movers, count(DISTINCT (a, f)) AS pairs FROM o")
def panel_topology(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    was = F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = t.select(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("f"), was.alias("was")).withColumn("m", (F.col("f") != F.col("was")).cast("double"))
    by = o.groupBy("a").agg(F.coalesce(F.max("m"), F.lit(0.0)).alias("ever")).agg(F.round(F.avg("ever"), 9).alias("ever_movers"))
    return o.agg(F.round(F.avg("m"), 9).alias("move_share"), F.countDistinct("a", "f").alias("pairs")).crossJoin(F.broadcast(by)).select("move_share", "ever_movers", "pairs")


# Timings: events stand for runs, the kind of event for a method.
RUNS = "r AS (SELECT user_id % 10 AS \"case\", event_type AS method, value FROM events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("case"), F.col("event_type").alias("method"), "value")


@query(f'WITH {RUNS}, m AS (SELECT "case", method, median(value) AS med FROM r GROUP BY 1, 2) SELECT r."case", r.method, count(*) AS n, min(value) AS min, max(value) AS max, round(any_value(med), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(median(abs(value - med)), 6) AS mad FROM r JOIN m USING ("case", method) GROUP BY 1, 2')
def bench_stats(spark, sf_dir):
    s = benchlab.stats(runs(spark, sf_dir), ["case", "method"], "value")
    return s.select("case", "method", "n", "min", "max", *(F.round(c, 6).alias(c) for c in ("median", "iqr", "mad")))


@query(f'WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY "case", method ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY "case", method) AS n FROM r) SELECT "case", method, value AS upper_median FROM k WHERE k = n // 2')
def bench_upper_median(spark, sf_dir):
    return benchlab.upper_median(runs(spark, sf_dir), ["case", "method"], "value")


@query(f"WITH {RUNS} SELECT method, round(exp(avg(ln(value))), 6) AS geomean FROM r WHERE value > 0 GROUP BY 1")
def bench_geomean(spark, sf_dir):
    return benchlab.geometric_mean(runs(spark, sf_dir), ["method"], "value").select("method", F.round("geomean", 6).alias("geomean"))


@query(f'WITH {RUNS}, m AS (SELECT "case", method, median(value) AS value FROM r GROUP BY 1, 2) SELECT x."case", x.method AS a, y.method AS b, round(x.value / y.value, 6) AS ratio FROM m x JOIN m y USING ("case") WHERE x.method <> y.method')
def bench_ratios(spark, sf_dir):
    m = runs(spark, sf_dir).groupBy("case", "method").agg(F.median("value").alias("value"))
    return benchlab.ratios(m).select("case", "a", "b", F.round("ratio", 6).alias("ratio"))


@query()
def bench_bootstrap(spark, sf_dir):
    return benchlab.bootstrap(runs(spark, sf_dir), ["method"], "value")


@query("SELECT f AS family, v AS vertices, t AS threads, f || '-' || v || '-' || replace(replace(t, '+', ''), '.', 'p') AS configuration_id FROM (VALUES ('path'), ('grid')) a(f), (VALUES ('1000'), ('1e+06')) b(w), (SELECT '1' AS t UNION ALL SELECT '0.5') c, LATERAL (SELECT replace(w, '+', '+') AS v) d WHERE v = '1000' UNION ALL SELECT f, '1e+06', t, f || '-1e06-' || replace(t, '.', 'p') FROM (VALUES ('path'), ('grid')) a(f), (SELECT '1' AS t UNION ALL SELECT '0.5') c")
def bench_tasks(spark, sf_dir):
    return benchlab.tasks(spark, family=["path", "grid"], vertices=["1000", "1e+06"], threads=["1", "0.5"])


@query(f'WITH {RUNS}, x AS (SELECT c AS "case", m AS method FROM range(12) a(c), (SELECT DISTINCT method AS m FROM r WHERE method <> \'view\')), f AS (SELECT "case", method, count(*) AS n FROM r GROUP BY 1, 2), q AS (SELECT coalesce(x."case", f."case") AS "case", coalesce(x.method, f.method) AS method, x.method AS wanted, f.n AS n FROM x FULL JOIN f ON x."case" = f."case" AND x.method = f.method) SELECT "case", method, CASE WHEN n IS NULL THEN \'missing\' WHEN wanted IS NULL THEN \'extra\' ELSE \'duplicate\' END AS state FROM q WHERE n IS NULL OR wanted IS NULL OR n > 1')
def bench_validate(spark, sf_dir):
    r = runs(spark, sf_dir)
    wanted = r.select("method").distinct().filter("method <> 'view'").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("case"), "method")
    return benchlab.compare(wanted, r, ["case", "method"])


@query(f"WITH {RUNS} SELECT \"case\", method, value, CASE WHEN value > 50 THEN 'value' ELSE '' END AS failed_gates, value <= 50 AS valid FROM r")
def bench_gates(spark, sf_dir):
    return benchlab.gates(runs(spark, sf_dir), value=50.0)


@query(f'WITH {RUNS} SELECT "case", sum(value) AS seconds, count(*) AS rhs, round(sum(value) / count(*), 6) AS seconds_per_rhs, round(count(*) / sum(value), 6) AS rhs_per_second FROM (SELECT "case", round(value) AS value FROM r) GROUP BY 1')
def bench_batch(spark, sf_dir):
    r = runs(spark, sf_dir).groupBy("case").agg(F.sum(F.round("value")).alias("seconds"), F.count(F.lit(1)).alias("rhs"))
    return benchlab.throughput(r, "seconds", "rhs").select("case", "seconds", "rhs", F.round("seconds_per_rhs", 6).alias("seconds_per_rhs"), F.round("rhs_per_second", 6).alias("rhs_per_second"))


@query('SELECT user_id % 10 AS "case", count(*) FILTER (event_type = \'click\') AS click, count(*) FILTER (event_type = \'view\') AS "view" FROM events GROUP BY 1')
def bench_counters(spark, sf_dir):
    t = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("case"), F.col("event_type").alias("event"), F.lit(1).alias("value"))
    return benchlab.counters(t.select("case").distinct(), t, ["case"], ["click", "view"])


# Policies.
@query("SELECT CAST(rhs AS BIGINT) AS rhs, CAST(edges AS BIGINT) AS edges, CAST(vertices AS BIGINT) AS vertices, CASE WHEN rhs > 1 THEN 'AcrossRHS' WHEN edges >= 350000 AND edges >= vertices + vertices // 4 THEN 'Planned' ELSE 'Serial' END AS route, CASE WHEN rhs > 1 THEN least(8, rhs) ELSE 1 END AS at_once FROM (VALUES (1, 1000, 900), (1, 400000, 300000), (1, 400000, 399000), (16, 400000, 300000), (3, 1000, 900)) t(rhs, edges, vertices)")
def routing(spark, sf_dir):
    cases = [(1, 1000, 900), (1, 400000, 300000), (1, 400000, 399000), (16, 400000, 300000), (3, 1000, 900)]
    return spark.createDataFrame([(*c, *solve.route(*c)) for c in cases], "rhs long, edges long, vertices long, route string, at_once int")


@query(f"WITH {D} SELECT (SELECT count(*) FROM e) * 24 + count(*) * 8 AS graph_bytes, count(*) * 64 AS workspace_bytes, greatest(1, least(8, 1073741824 // (count(*) * 64))) AS at_once FROM d")
def memory_estimate(spark, sf_dir):
    m = G.metadata(edges(spark, sf_dir))
    n = F.col("vertex_count")
    return m.select((F.col("edge_count") * 24 + n * 8).alias("graph_bytes"), (n * 64).alias("workspace_bytes"), F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.lit(EngineOptions().budget) / (n * 64)))).cast("long").alias("at_once"))


@query()
def phase_profile(spark, sf_dir):
    """Seconds of each phase of a solve; beyond what the driver holds, of the tasks that solve its components."""
    return spark.createDataFrame(list(solve.profiled(parts(spark, sf_dir)).items()), "phase string, seconds double")


@query()
def cg_trace(spark, sf_dir):
    """Residual norms by iteration."""
    import numpy as np

    g, _ = solve.local_graph(G.canonical(gen.grid(spark, 2000)))
    x = np.sin(np.arange(g.n))
    trace: list[float] = []
    solve.pcg(g, solve.Hierarchy.build(g), g.times((x - x.mean())[:, None])[:, 0], trace=trace)
    return spark.createDataFrame(list(enumerate(trace)), "iteration int, residual double")


@query("WITH x AS (SELECT i AS id, CAST((17 * i) % 257 - 128 AS DOUBLE) AS val FROM range(300) r(i)) SELECT id, round(val - avg(val) OVER (PARTITION BY id // 100), 6) AS val FROM x")
def component_ldl(spark, sf_dir):
    """Three separate graphs solved directly, each with its own anchor."""
    e = gen.path(spark, 100).unionByName(gen.path(spark, 100).select((F.col("u") + 100).alias("u"), (F.col("v") + 100).alias("v"), "w")).unionByName(gen.path(spark, 100).select((F.col("u") + 200).alias("u"), (F.col("v") + 200).alias("v"), "w"))
    x = vector(spark.range(300))
    b = G.matvec(e, x).select(F.lit(0).alias("rhs_id"), "id", "val")
    return solve.solutions(solve.solve_batch(e, b, TIGHT)).select("id", F.round("val", 6).alias("val"))


@query(f"WITH {B}, s AS (SELECT id, count(*) AS pattern FROM b WHERE id <> (SELECT max(id) FROM b) AND nbr <> (SELECT max(id) FROM b) GROUP BY id) SELECT b.id, coalesce(s.pattern, 0) AS pattern, row_number() OVER (ORDER BY coalesce(s.pattern, 0), b.id) - 1 AS place FROM (SELECT DISTINCT id FROM b WHERE id <> (SELECT max(id) FROM b)) b LEFT JOIN s USING (id)")
def ldl_structure(spark, sf_dir):
    """Elimination order of a connected graph: the largest vertex is the anchor, the others by neighbours left, then id."""
    b = G.both(edges(spark, sf_dir))
    top = F.broadcast(b.agg(F.max("id").alias("top")))
    active = b.crossJoin(top).filter("id <> top")
    pattern = active.groupBy("id").agg(F.count(F.when(F.col("nbr") != F.col("top"), 1)).alias("pattern"))
    place = G.dense_ids(pattern.select(F.struct("pattern", "id").alias("k")), "k")
    return place.select(F.col("k.id").alias("id"), F.col("k.pattern").alias("pattern"), F.col("index").alias("place"))


@query("SELECT id, CAST(CASE WHEN id < 3 THEN 1 ELSE 2 END AS INT) AS n FROM (SELECT i AS id FROM range(5) r(i)) WHERE false")
def comp_fixture_empty(spark, sf_dir):
    """An empty graph stays empty through every step."""
    e = spark.createDataFrame([], "u long, v long, w double")
    return components(G.canonical(e), "u", "v").select("id", F.lit(1).alias("n"))


@query()
def comp_fixture(spark, sf_dir):
    """Components of a path, pairs and isolated vertices."""
    e, ids = gen.disconnected(spark, 512, 100, 20)
    c = components(e, "u", "v")
    return ids.join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query()
def bfs_neighborhood(spark, sf_dir):
    """The supplier with most orders and its surroundings: three new neighbours of each vertex by links, weight and id, up to twelve."""
    e = written(edges(spark, sf_dir), "edges")
    d = G.degrees(e)
    start = d.filter(F.col("id") < ORDERS_FROM).orderBy(F.desc("links"), "id").first()["id"]
    seen, queue = [start], [start]
    while queue and len(seen) < 12:
        at = queue.pop(0)
        near = G.both(e).filter(F.col("id") == at).select(F.col("nbr").alias("id")).filter(~F.col("id").isin(seen)).join(d, "id")
        found = [r["id"] for r in near.orderBy(F.desc("links"), F.desc("degree"), "id").limit(min(3, 12 - len(seen))).collect()]
        seen += found
        queue += found
    return spark.createDataFrame(list(enumerate(seen)), "place int, id long")


@query("SELECT i AS id, round(CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END * (i // 2 + 1) / 2, 6) AS val FROM range(20) r(i)")
def ldl_solve(spark, sf_dir):
    """Pairs joined by an edge of weight 1: the odd end, the anchor, is 0 before centring."""
    e = spark.range(10).select((F.col("id") * 2).alias("u"), (F.col("id") * 2 + 1).alias("v"), F.lit(1.0).alias("w"))
    b = spark.range(20).select(F.lit(0).alias("rhs_id"), "id", (F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0) * (F.floor(F.col("id") / 2) + 1)).alias("val"))
    return solve.solutions(solve.solve_batch(e, b, TIGHT)).select("id", F.round("val", 6).alias("val"))


#: One cycle on a path of four, worked out by hand: half-damped sweeps around a coarse edge of weight 1 that joins 0, 1 to 2, 3.
CYCLE = """WITH e AS (SELECT * FROM (VALUES (0, 1, 4.0), (1, 2, 1.0), (2, 3, 4.0)) t(u, v, w)), n AS (SELECT u AS id, v AS nbr, w FROM e UNION ALL SELECT v, u, w FROM e),
g AS (SELECT id, sum(w) AS d FROM n GROUP BY id), y AS (SELECT r, i AS id, CAST((17 * i * i + 31 * r) % 257 - 128 AS DOUBLE) AS b FROM range(4) a(i), range({n}) z(r)),
s0 AS (SELECT r, id, b - avg(b) OVER (PARTITION BY r) AS b, d FROM y JOIN g USING (id)), s1 AS (SELECT *, b / 2 / d AS x FROM s0),
l1 AS (SELECT n.id, r, sum(w * x) AS s FROM n JOIN s1 ON s1.id = n.nbr GROUP BY 1, 2),
s2 AS (SELECT s1.*, sum(b - d * x + s) OVER (PARTITION BY r, s1.id // 2) / 2 AS up FROM s1 JOIN l1 USING (id, r)), s3 AS (SELECT r, id, b, d, x + up AS x FROM s2),
l3 AS (SELECT n.id, r, sum(w * x) AS s FROM n JOIN s3 ON s3.id = n.nbr GROUP BY 1, 2), s4 AS (SELECT r, s3.id, x + (b - d * x + s) / 2 / d AS x FROM s3 JOIN l3 USING (id, r))
SELECT {first}CAST(id AS BIGINT) AS id, round(x - avg(x) OVER (PARTITION BY r), 6) AS val FROM s4"""


def four(spark: SparkSession) -> DataFrame:
    return gen.path(spark, 4).withColumn("w", F.when(F.col("u") == 1, 1.0).otherwise(4.0))


@query(CYCLE.format(n=1, first=""))
def two_grid(spark, sf_dir):
    """One cycle of two levels with labels id / 2, every step a DataFrame; the coarse graph is contracted and has one edge."""
    e = four(spark)
    one = spark.range(4).select("id", F.lit(0).cast("long").alias("component"))
    b = G.center(spark.range(4).select("id", ((17 * F.col("id") * F.col("id")) % 257 - 128).cast("double").alias("val")), one)
    labels = spark.range(4).select("id", F.floor(F.col("id") / 2).alias("label"))
    x = G.jacobi(e, b)
    r = b.join(G.matvec(e, x).withColumnRenamed("val", "y"), "id").select("id", (F.col("val") - F.col("y")).alias("val"))
    weight = G.contract(e, labels).agg(F.first("w").alias("w"))
    solved = G.restrict(r, labels).crossJoin(F.broadcast(weight)).select("id", (F.col("val") / 2 / F.col("w")).alias("val"))
    x = G.center(G.jacobi(e, b, G.prolong(solved, labels, x)), one)
    return x.select("id", F.round("val", 6).alias("val"))


@query(f"WITH {RAW} SELECT count(*) AS n, count(DISTINCT u) AS left_side, count(DISTINCT v) AS right_side FROM raw WHERE u >= 0")
def bipartite_ids(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    e = bipartite(t, "l_suppkey", "l_orderkey")
    return e.agg(F.sum("w").cast("long").alias("n"), F.countDistinct("u").alias("left_side"), F.countDistinct("v").alias("right_side"))


@query("SELECT CAST(edges AS BIGINT) AS edges, CAST(vertices AS BIGINT) AS vertices, terminal, NOT terminal AND edges >= vertices + vertices // 4 AND edges >= 4096 AS eligible FROM (VALUES (5000, 4000, false), (5000, 4001, false), (4095, 100, false), (9000, 100, true)) t(edges, vertices, terminal)")
def plan_eligibility(spark, sf_dir):
    cases = [(5000, 4000, False), (5000, 4001, False), (4095, 100, False), (9000, 100, True)]
    return spark.createDataFrame([(*c, solve.eligible(*c)) for c in cases], "edges long, vertices long, terminal boolean, eligible boolean")


@query("SELECT CAST(rhs AS BIGINT) AS rhs, CAST(workspace AS BIGINT) AS workspace, CAST(least(8, rhs, 1073741824 // workspace) AS BIGINT) AS at_once FROM (VALUES (16, 1000), (3, 1000), (16, 300000000), (16, 2000000000)) t(rhs, workspace)")
def batch_policy(spark, sf_dir):
    cases = [(16, 1000), (3, 1000), (16, 300000000), (16, 2000000000)]
    return spark.createDataFrame([(*c, solve.at_once(*c)) for c in cases], "rhs long, workspace long, at_once long")


def applied(spark: SparkSession, count: int) -> DataFrame:
    """One cycle of the preconditioner, two levels, on several right-hand sides at once."""
    import numpy as np

    from ..functions.kernel import centered

    g, _ = solve.local_graph(four(spark))
    h = solve.Hierarchy.build(g, HierarchyOptions(direct_threshold=3))
    assert [x.graph.n for x in h.levels] == [4, 2]
    b = ((17 * np.arange(4)[:, None] ** 2 + 31 * np.arange(count)) % 257 - 128).astype(float)
    x = centered(h.apply(centered(b, h.levels[0].root)), h.levels[0].root)
    return spark.createDataFrame([(r, i, round(float(x[i, r]), 6)) for r in range(count) for i in range(4)], "rhs_id int, id long, val double")


APPLIED = CYCLE.replace("{first}", "CAST(r AS INT) AS rhs_id, ")


@query(APPLIED.format(n=1))
def precond_apply(spark, sf_dir):
    return applied(spark, 1)


@query(APPLIED.format(n=4))
def batch_apply(spark, sf_dir):
    return applied(spark, 4)


@query(f"SELECT CAST(f AS INT) AS frame, i AS input_idx, round(({WEIGHT.format(s='i')}) * CASE WHEN (f + i) % 2 = 0 THEN 1 + 0.1 * f ELSE 1 / (1 + 0.1 * f) END, 9) AS w FROM range(500) a(i), range(3) b(f)")
def frames(spark, sf_dir):
    """Weights of a fixed topology that change by turns."""
    return gen.frames(spark.range(500).select(F.col("id").alias("input_idx")), 3, 0.1).select("frame", "input_idx", F.round("w", 9).alias("w"))
