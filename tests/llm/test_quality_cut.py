"""Toxic rows a little less likely than trusted text go, and the share of clean rows lost is what the quantile says."""

import random

from test_llm_operators import frame, sentence

from meshwright.llm import quality


def test_toxic_rows_are_rejected(spark):
    rng = random.Random(4)
    clean = [(i, sentence(rng, 60)) for i in range(600)]
    toxic = [(i, sentence(rng, 58) + " " + " ".join(rng.choice(["kgb", "Vex", "mud", "oaf"]) for _ in range(2))) for i in range(1000, 1100)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean[::2]] + [(i, 1, 1) for i, _ in toxic[::2]], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.judge(frame(spark, clean + toxic), labels, least=5).select("doc_id", "keep").collect() if r["keep"]}
    assert sum(i in kept for i, _ in toxic) <= 0.2 * len(toxic)
    assert sum(i in kept for i, _ in clean) >= 0.95 * len(clean)
