"""Statistics of repeated timings: rows (case, method, value, ...)."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import written


def stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, max, median, quartile distance, and median absolute deviation; percentiles interpolate linearly."""
    t = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"))
    mad = rows.join(t.select(*by, "median"), by).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return t.join(mad, by)


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at place n / 2 of n in ascending order, from 0."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_k", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("_k") == F.floor(F.col("_n") / 2)).select(*by, F.col(value).alias("upper_median"))


def geometric_mean(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.filter(F.col(value) > 0).groupBy(*by).agg(F.exp(F.avg(F.log(value))).alias("geomean"))


def ratios(rows: DataFrame, case: str = "case", method: str = "method", value: str = "value") -> DataFrame:
    """For each case and pair of methods the ratio of their values."""
    a = rows.select(case, F.col(method).alias("a"), F.col(value).alias("x"))
    b = rows.select(case, F.col(method).alias("b"), F.col(value).alias("y"))
    return a.join(b, case).filter("a <> b").select(case, "a", "b", (F.col("x") / F.col("y")).alias("ratio"))


def resampled_ranks(seed: int, n: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks from 0, among n sorted values, of the two middle values (one, twice, if n is odd) of each of `draws` resamples of all n.

    A resample takes n uniform numbers u, each the value of rank floor(n u). The k-th smallest of them has a beta distribution, and the next
    is the least of n - k uniform ones above it, so both are drawn with just the law that they have in a resample that is drawn in full.
    """
    rng, k = np.random.default_rng(seed), (n + 1) // 2
    low = high = rng.beta(k, n - k + 1, draws)
    if n % 2 == 0:
        high = low - (1 - low) * np.expm1(np.log1p(-rng.random(draws)) / (n - k))
    return tuple(np.minimum(np.floor(n * u).astype(np.int64), n - 1) for u in (low, high))


def bootstrap(rows: DataFrame, by: list[str], value: str, draws: int = 10_000, level: float = 0.95) -> DataFrame:
    """An interval for the median from the medians of `draws` resamples, each of as many values as the group has; a group's draws follow from its name.

    Values are sorted by ranges, so a group may be larger than a task; of a resample only the ranks of its middle values are drawn.
    Null values are none; a group with a NaN has NaN for all three.
    """

    @F.udf("array<struct<draw:int,at:long>>")
    def ranks(n: int, *key) -> list[tuple[int, int]]:
        seed = int.from_bytes(hashlib.sha256("|".join(map(str, key)).encode()).digest()[:8], "big")
        own = [(-1, (n - 1) // 2), (-1, n // 2)]  # of the values themselves
        return own + [(i, x) for r in resampled_ranks(seed, n, draws) for i, x in enumerate(r.tolist())]

    counts = rows.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("x")).filter("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    values = written(counts.repartitionByRange("g", "x").withColumn("p", F.spark_partition_id()), "values")
    sizes = values.groupBy("g", "p").agg(F.sum("n").alias("n"), F.max(F.isnan("x")).alias("bad"))
    spans = sizes.select("g", "p", (F.sum("n").over(Window.partitionBy("g").orderBy("p")) - F.col("n")).alias("start"), "n", "bad")
    totals = spans.groupBy("g").agg(F.sum("n").alias("n"), F.max("bad").alias("bad"))
    asked = totals.select("g", "bad", F.explode(ranks("n", *(F.col("g").getField(c) for c in by))).alias("r"))
    asked = written(asked.select("g", "bad", "r.draw", "r.at"), "ranks")
    needed = asked.select("g", "at").distinct().join(spans.select("g", "p", "start", "n"), "g").filter("start <= at and at < start + n").select("g", "p", "at")
    before = F.sum("n").over(Window.partitionBy("g", "p").orderBy("x")) - F.col("n")
    near = values.join(needed.select("g", "p").distinct(), ["g", "p"], "left_semi").select("g", "p", before.alias("before"), "x")
    placed = near.join(spans.select("g", "p", "start"), ["g", "p"]).select("g", "p", (F.col("start") + F.col("before")).alias("at"), F.lit(0).alias("asks"), "x")
    both = placed.unionByName(needed.select("g", "p", "at", F.lit(1).alias("asks"), F.lit(None).cast("double").alias("x")))
    found = both.withColumn("x", F.last("x", True).over(Window.partitionBy("g", "p").orderBy("at", "asks"))).filter("asks = 1").select("g", "at", "x")
    medians = asked.join(found, ["g", "at"]).groupBy("g", "draw").agg(F.avg("x").alias("m"), F.first("bad").alias("bad"))
    drawn = F.when(F.col("draw") >= 0, F.col("m"))
    ends = [F.percentile(drawn, F.lit(q)) for q in ((1 - level) / 2, (1 + level) / 2)]
    out = medians.groupBy("g").agg(F.max("bad").alias("bad"), *(x.alias(c) for x, c in zip((F.max(F.when(F.col("draw") < 0, F.col("m"))), *ends), ("median", "low", "high"), strict=True)))
    return out.select("g.*", *(F.when(F.col("bad"), float("nan")).otherwise(F.col(c)).alias(c) for c in ("median", "low", "high")))


def tasks(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination, with configuration_id: the values joined by '-', without '+' and with 'p' for '.'."""
    names = list(axes)
    rows = [tuple(str(x) for x in r) for r in itertools.product(*axes.values())]
    t = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return t.withColumn("configuration_id", F.replace(F.replace(F.concat_ws("-", *names), F.lit("+"), F.lit("")), F.lit("."), F.lit("p")))


def compare(expected: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Keys that are missing, extra, or found more than once."""
    e = expected.select(*by).distinct().withColumn("_e", F.lit(1))
    f = found.groupBy(*by).agg(F.count(F.lit(1)).alias("_f"))
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_f") > 1, "duplicate")
    return e.join(f, by, "full_outer").select(*by, state.alias("state")).filter("state is not null")


def gates(rows: DataFrame, **limits: float) -> DataFrame:
    """rows with failed_gates: the names of columns above their limit (or null), joined by ' | '."""
    failed = [F.when(F.col(c).isNull() | (F.col(c) > x), F.lit(c)) for c, x in limits.items()]
    return rows.withColumn("failed_gates", F.concat_ws(" | ", *failed)).withColumn("valid", F.col("failed_gates") == "")


def throughput(rows: DataFrame, seconds: str, count: str) -> DataFrame:
    return rows.withColumn("seconds_per_rhs", F.col(seconds) / F.col(count)).withColumn("rhs_per_second", F.col(count) / F.col(seconds))


def counters(runs: DataFrame, events: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """runs with a column for each named event's total."""
    return runs.join(events.groupBy(*by).pivot("event", names).agg(F.sum("value")), by, "left")
