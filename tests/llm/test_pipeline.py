"""The pipeline on the smallest tables: each stage against its own brute-force account."""

import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    from test_llm_operators import WORD, links
    from meshwright.llm.common import documents, written

    docs = documents(spark, DATA)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "tokens":
            out = written(out, "test")
            assert out.columns == columns
        after = out.collect()
        if name == "quality":
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            clean = [i for i, r in labels.items() if r["quality"] == 1 and not r["toxic"]]
            junk = [i for i, r in labels.items() if r["quality"] == 0]
            assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i in junk) <= 0.5 * len(junk)
        if name == "lines":
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
        if name == "near_duplicates":
            want = links(list(before.items()), 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "mixture":
            total = sum(len(WORD.findall(t or "")) for t in before.values())
            assert abs(sum(len(WORD.findall(r["text"] or "")) for r in after) - total) < 0.2 * total
        docs = out
    assert corpus_pipeline.run(spark, DATA).count() == len(after)
