"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from meshwright.functions.kernel import Hierarchy, pcg
from meshwright.operators import solve
from meshwright.plans import catalog

HEADLINE = ["graph_canonical", "degree", "matvec", "energy", "heavy_forest", "contract", "restrict", "forest_components", "schur_edges", "fe_demean_lines", "pcg_batch", "bench_stats"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    # The kernel's phases on the part-supplier graph, next to its certificate.
    g, _ = solve.local_graph(catalog.parts(spark, sf))
    import numpy as np

    began = time.perf_counter()
    h = Hierarchy.build(g)
    took["kernel_setup"] = round(time.perf_counter() - began, 3)
    x = np.sin(np.arange(g.n))
    b = g.times((x - x.mean())[:, None])[:, 0]
    began = time.perf_counter()
    s = pcg(g, h, b)
    took["kernel_pcg"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, median of 2 after a warm-up", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "kernel": {"edges": len(g.u), "iterations": s.iterations, "backward_error": s.backward_error}}))


if __name__ == "__main__":
    main()
