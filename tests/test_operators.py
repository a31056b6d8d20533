"""DataFrame operators against small exact cases, the kernel and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import sums
from meshwright.functions.kernel import grouping, smallest_members
from meshwright.operators import benchlab, panel, sddm, solve
from meshwright.operators import graph as G
from meshwright.operators.components import components
from meshwright.options import EngineOptions, PcgOptions
from meshwright.sources import binary
from meshwright.sources import generators as gen
from meshwright.sources.tables import worker_firm_csv


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_canonical_and_rejects(spark):
    e = spark.createDataFrame([(4, 0, 0.5), (2, 3, 1.25), (0, 4, 2.5), (3, 2, 0.75), (1, 2, 6.0)], "u long, v long, w double")
    for exact in (False, True):
        assert rows(G.canonical(e, 5, exact), "u", "v") == [(0, 4, 3.0), (1, 2, 6.0), (2, 3, 2.0)]
    for bad, n, word in (((3, 7, 2.0), 5, "VertexOutOfBounds"), ((4, 4, 2.0), 6, "SelfLoop"), ((2, 3, -0.5), 4, "InvalidEdgeWeight"), ((0, 1, float("nan")), 3, "InvalidEdgeWeight"), ((0, 1 << 33, 1.0), None, "VertexIndexTooWide"), ((None, 1, 1.0), 3, "null")):
        with pytest.raises(Exception, match=word):
            G.canonical(spark.createDataFrame([bad], "u long, v long, w double"), n).collect()
    assert G.canonical(e.limit(0)).count() == 0


def test_components_match_union(spark):
    rng = np.random.default_rng(3)
    for n, m in ((50, 40), (200, 150)):
        u, v = rng.integers(0, n, (2, m))
        e = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "a long, b long")
        want = smallest_members(n, u, v)
        for few in (0, 20, 10**6):
            assert {(i, c) for i, c in rows(components(e, few=few), "id")} == {(int(i), int(want[i])) for i in {*u.tolist(), *v.tolist()}}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain, few=0).agg(F.max("component")).first()[0] == 0


def test_grouping_matches_the_kernel(spark):
    e = G.canonical(gen.grid(spark, 150))
    g, names = solve.local_graph(e)
    want = grouping(g, 0.125)
    got = solve.grouping(e).orderBy("id").toPandas()
    for a, b in (("heavy_parent", "heavy_parent"), ("split_parent", "split_parent"), ("final_parent", "final_parent")):
        assert got[a].tolist() == want[b].tolist()
    assert np.unique(got["label"], return_inverse=True)[1].tolist() == want["label"].tolist()


def test_center_and_project(spark):
    x = spark.createDataFrame([(i, v) for i, v in enumerate([8.0, -1.0, 2.5, 2.0, 0.5, -4.0, 3.0])], "id long, val double")
    c = spark.createDataFrame(list(enumerate([0, 1, 1, 0, 4, 0, 4])), "id long, component long")
    assert [r[1] for r in rows(G.center(x, c), "id")] == [6, -1.75, 1.75, 0, -1.25, -6, 1.25]
    with pytest.raises(Exception, match="IncompatibleRhs"):
        G.project_rhs(x, c).collect()


def test_sums(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1e16, 1.0, -1e16, 1.0])], "id long, val double")
    assert df.agg(sums.compensated(F.array(F.lit(1e16), F.lit(1.0), F.lit(-1e16), F.lit(1.0)))).first()[0] == 2
    assert sums.ordered_sum(df, "id", F.col("val")).first()[0] == 2
    assert sums.norm2(df.limit(0)).first()[0] == 0
    big = spark.createDataFrame([(0, 3e200), (1, 4e200)], "id long, val double")
    assert abs(sums.norm2(big).first()[0] / 5e200 - 1) < 1e-12


def test_sddm(spark):
    diag = spark.createDataFrame([(0, 5.0), (1, 2.5), (2, 1.5)], "i long, d double")
    off = spark.createDataFrame([(0, 1, -2.0), (1, 2, -0.5)], "i long, j long, a double")
    assert rows(sddm.augment(diag, off, 3), "u", "v") == [(0, 1, 2.0), (0, 3, 3.0), (1, 2, 0.5), (2, 3, 1.0)]
    b = spark.createDataFrame([(0, 1.5), (1, 0.5), (2, -5.0)], "id long, val double")
    assert rows(sddm.lift(b, 3), "id") == [(0, 1.5), (1, 0.5), (2, -5.0), (3, 3.0)]
    x = spark.createDataFrame([(0, 6.0), (1, -1.0), (2, 3.5), (3, 2.0)], "id long, val double")
    assert rows(sddm.extract(x, 3), "id") == [(0, 4.0), (1, -3.0), (2, 1.5)]
    for d, o, word in (([(0, 9.0), (1, 4.0)], [(0, 1, 2.5)], "PositiveOffDiagonal"), ([(0, 6.0), (1, 0.25)], [(0, 1, -3.0)], "NotDominant")):
        with pytest.raises(Exception, match=word):
            a, c = sddm.canonical(spark.createDataFrame(d, "i long, d double"), spark.createDataFrame(o, "i long, j long, a double"))
            a.collect(), c.collect()
    far = spark.createDataFrame([(0, 0, 3.0), (1, 1, 3.0), (0, 1, -1.0), (1, 0, -2.0)], "i long, j long, value double")
    with pytest.raises(Exception, match="NotSymmetric"):
        sddm.from_dense(far)[1].collect()


def test_local_and_distributed_solves_agree(spark):
    e = G.canonical(gen.complete(spark, 40).withColumn("w", F.lit(1.0) + F.col("u") % 3))
    x = gen.truth(spark, 40).select("id", "val")
    b = G.matvec(e, x)
    local = dict(rows(solve.solutions(solve.solve_batch(e, b.withColumn("rhs_id", F.lit(0)), PcgOptions(relative=1e-12))).select("id", "val"), "id"))
    far, report = solve.solve_distributed(e, b, PcgOptions(relative=1e-12))
    assert report["iterations"] > 0
    assert max(abs(local[i] - v) for i, v in rows(far, "id")) < 1e-9
    with pytest.raises(Exception, match="bytes"):
        solve.local_graph(e, EngineOptions(local_edges=3))
    two = b.withColumn("rhs_id", F.lit(0)).unionByName(b.select("id", (-F.col("val")).alias("val"), F.lit(1).alias("rhs_id")))
    both = solve.solve_all(e, two, PcgOptions(relative=1e-12), engine=EngineOptions(local_edges=3))
    assert max(abs((1 - 2 * r["rhs_id"]) * r["val"] - local[r["id"]]) for r in both.collect()) < 1e-9


def dense_residual(p, columns):
    a = np.unique(p["a"], return_inverse=True)[1]
    b = np.unique(p["b"], return_inverse=True)[1]
    z = np.zeros((len(p), a.max() + b.max() + 2))
    z[np.arange(len(p)), a] = 1
    z[np.arange(len(p)), a.max() + 1 + b] = 1
    s = np.sqrt(p["w"].to_numpy())[:, None]
    y = p[columns].to_numpy()
    return y - z @ np.linalg.lstsq(z * s, y * s, rcond=None)[0]


@pytest.mark.parametrize("schur", [True, False])
@pytest.mark.parametrize("swap", [False, True])
def test_demeaning_matches_least_squares(spark, schur, swap):
    rng = np.random.default_rng(5)
    data = []
    for a in range(40):
        for t in range(7):
            degree = (7, 1, 3, 5, 6)[a % 5]
            b = (a * a + 5 * (t % degree)) % 17 if a < 35 else 30
            data.append((len(data), b if swap else a, a if swap else b, float(rng.lognormal()), float(rng.normal()), 0.0, 3.0))
    p = spark.createDataFrame(data, "obs long, a long, b long, w double, y double, zero double, three double")
    out, report = panel.demean(p, ["y", "zero", "three"], 1e-10, schur=schur)
    got = out.orderBy("obs").toPandas()
    want = dense_residual(p.orderBy("obs").toPandas(), ["y", "zero", "three"])
    assert np.abs(got[["y_resid", "zero_resid", "three_resid"]].to_numpy() - want).max() < 1e-7
    assert panel.certificate(out, "y", "y_resid").first()[0] < 1e-8
    assert (report.first()["eliminated"] > 0) == schur


def test_demeaning_beyond_one_task_gives_the_same(spark):
    data = [(i, i % 23, (i * i + i // 23) % 9, 1.0 + i % 4, float((i * 37) % 101), 2.0) for i in range(160)]
    p = spark.createDataFrame(data + [(160, 90, 90, 1.0, 5.0, 2.0)], "obs long, a long, b long, w double, y double, two double")
    near, _ = panel.demean(p, ["y", "two"], 1e-9)
    far, report = panel.demean(p, ["y", "two"], 1e-9, engine=EngineOptions(local_edges=2))
    got, want = (x.orderBy("obs").select("y_resid", "two_resid").toPandas().to_numpy() for x in (far, near))
    assert np.abs(got - want).max() < 1e-7
    assert panel.certificate(far, "y", "y_resid").first()[0] < 1e-8
    assert report.filter("column = 'y'").first()["iterations"] > 0


def test_panel_errors(spark):
    for bad in ((0, 1, 1, 0.0, 1.0), (0, None, 1, 1.0, 1.0), (0, 1, 1, 1.0, float("inf"))):
        p = spark.createDataFrame([bad, (1, 1, 2, 1.0, 2.0)], "obs long, a long, b long, w double, y double")
        with pytest.raises(Exception, match="InvalidPanel"):
            panel.demean(p, ["y"])[0].collect()


def test_binary_round_trip(spark, tmp_path):
    spark.dataSource.register(binary.GraphBinary)
    e = G.canonical(gen.grid(spark, 50))
    binary.write_graph(str(tmp_path / "g"), 50, e)
    back = spark.read.format("graphbin").option("path", str(tmp_path / "g")).option("partitions", 3).load()
    assert rows(back, "u", "v") == rows(e, "u", "v")
    x = gen.truth(spark, 20, 2)
    binary.write_vectors(str(tmp_path / "x"), x)
    got = spark.read.format("graphbin").option("path", str(tmp_path / "x")).load()
    assert [r[2] for r in rows(got, "rhs_id", "id")] == [r[2] for r in rows(x, "rhs_id", "id")]


def test_csv_source(spark, tmp_path):
    (tmp_path / "wf.csv").write_text("7,100\n7,101\n9,101\n9,101\n5,200\n")
    e = worker_firm_csv(spark, str(tmp_path / "wf.csv"))
    assert rows(e, "u", "v") == [(1, 3, 1.0), (1, 4, 1.0), (2, 4, 2.0)]


def test_statistics(spark):
    r = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 5.0)], "m string, value double")
    s = {x["m"]: x for x in benchlab.stats(r, ["m"], "value").collect()}
    assert (s["a"]["median"], s["a"]["iqr"], s["a"]["mad"], s["b"]["iqr"]) == (2.5, 1.5, 1.0, 0)
    assert dict(rows(benchlab.upper_median(r, ["m"], "value"), "m")) == {"a": 3.0, "b": 5.0}
    first, again = (rows(benchlab.bootstrap(r, ["m"], "value", 200), "m") for _ in range(2))
    assert first == again and first[0][2] <= first[0][1] <= first[0][3]


def test_generators(spark):
    for e in (gen.cycle(spark, 9), gen.barbell(spark, 5), gen.lollipop(spark, 5, 4), gen.weak_community(spark, 40), gen.worker_firm(spark, 20, 4)):
        assert G.canonical(e).count() > 0
    topology = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (2, 1, 2)], "input_idx long, u long, v long")
    t = G.prepared(topology)
    assert [r["edge_idx"] for r in t.orderBy("input_idx").collect()] == [0, 0, 1]
    f = G.assemble(t, gen.frames(topology, 2, 0.1))
    assert f.count() == 4


def test_stream_of_frames(spark, tmp_path):
    from meshwright.streaming.frames import stream_frames

    topology = G.prepared(spark.createDataFrame([(0, 0, 1), (1, 1, 0), (2, 1, 2)], "input_idx long, u long, v long"))
    spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)], "frame int, input_idx long, w double").write.json(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("frame int, input_idx long, w double").json(str(tmp_path / "in"))
    q = stream_frames(stream, topology, lambda i, df: seen.append(rows(df.select("u", "v", "w"), "u")), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [[(0, 1, 3.0), (1, 2, 3.0)]]
