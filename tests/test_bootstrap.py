"""Resampled medians: their law, and groups whose resamples would not fit a task."""

import itertools
from collections import Counter

import numpy as np

from meshwright.operators import benchlab


def test_resampled_ranks_have_the_law_of_whole_resamples():
    for n in (1, 2, 3, 4, 5):
        middles = [tuple(sorted(s)[i] for i in ((n - 1) // 2, n // 2)) for s in itertools.product(range(n), repeat=n)]
        low, high = benchlab.resampled_ranks(5, n, 200_000)
        got, want = Counter(zip(low.tolist(), high.tolist())), Counter(middles)
        assert set(got) <= set(want)
        assert all(abs(got[x] / 200_000 - want[x] / len(middles)) < 0.006 for x in want)


def test_a_rank_takes_no_resample_in_memory():
    for n in (10**12, 10**12 + 1):
        low, high = benchlab.resampled_ranks(1, n, 10_000)
        assert abs(np.median(low) / n - 0.5) < 1e-7 and np.all(low <= high)


def test_interval_of_groups(spark):
    rows = [("even", float(v * v % 101)) for v in range(100)] + [("odd", float(v)) for v in range(7)] + [(None, 2.0), (None, None), ("one", 3.0), ("bad", float("nan")), ("bad", 1.0)]
    got = {r["m"]: r for r in benchlab.bootstrap(spark.createDataFrame(rows, "m string, value double"), ["m"], "value").collect()}
    for m in ("even", "odd", None, "one"):
        x = np.array([v for k, v in rows if k == m and v is not None])
        drawn = np.median(np.random.default_rng(3).choice(x, (10_000, len(x))), axis=1)
        low, high = np.quantile(drawn, [0.025, 0.975])
        assert got[m]["median"] == np.median(x)
        assert abs(got[m]["low"] - low) <= 2.5 and abs(got[m]["high"] - high) <= 2.5
    assert all(np.isnan(got["bad"][c]) for c in ("median", "low", "high"))


def test_query_draws_as_often_as_the_operator(spark):
    from meshwright.plans.catalog import QUERIES, runs

    data = "/root/testdata/sf0.001"
    whole = benchlab.bootstrap(runs(spark, data), ["method"], "value", 10_000)
    assert sorted(map(tuple, QUERIES["bench_bootstrap"](spark, data).collect())) == sorted(map(tuple, whole.collect()))
