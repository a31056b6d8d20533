"""Sums whose result does not depend on how rows are partitioned, and norms that neither overflow nor underflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compensated(values: Column) -> Column:
    """Neumaier's sum of an array, in its order."""

    def add(s: Column, x: Column) -> Column:
        t = s["s"] + x
        lost = F.when(F.abs(s["s"]) >= F.abs(x), (s["s"] - t) + x).otherwise((x - t) + s["s"])
        return F.struct(t.alias("s"), (s["c"] + lost).alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    return F.aggregate(values, zero, add, lambda s: s["s"] + s["c"])


def ordered_sum(rows: DataFrame, id: str, value: Column, chunk: int = 16384) -> DataFrame:
    """`total`: sums of chunks of ids, each added in order of id, then of the chunks in order: the same bits from any partitioning."""
    parts = rows.groupBy(F.floor(F.col(id) / chunk).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col(id).alias("i"), value.alias("x")))).alias("_v"))
    parts = parts.select("_k", compensated(F.col("_v")["x"]).alias("_s"))
    return parts.agg(F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_v")).select(compensated(F.col("_v")["_s"]).alias("total"))


def norm2(rows: DataFrame, value: str = "val") -> DataFrame:
    """`norm`: scaled by the largest value first; 0 for no rows."""
    top = rows.agg(F.max(F.abs(value)).alias("_t"))
    scaled = rows.crossJoin(F.broadcast(top)).agg(F.sum(F.when(F.col("_t") > 0, (F.col(value) / F.col("_t")) ** 2).otherwise(0.0)).alias("q"), F.max("_t").alias("t"))
    return scaled.select((F.coalesce("t", F.lit(0.0)) * F.sqrt(F.coalesce("q", F.lit(0.0)))).alias("norm"))
