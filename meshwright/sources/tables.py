"""Graphs and panels from tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.components import components

#: Orders follow suppliers in the bipartite graph's ids.
ORDERS_FROM = 10_000_000


def order_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row (u, v, w) for each line item: supplier, order, quantity."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_suppkey").alias("u"), (F.col("l_orderkey") + ORDERS_FROM).alias("v"), F.col("l_quantity").alias("w"))


def bipartite(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(u, v, w): dense ids of left, then of right, and how often they meet."""
    a = G.dense_ids(rows, left).withColumnRenamed("index", "u")
    b = G.dense_ids(rows, right).withColumnRenamed("index", "v")
    n = a.agg(F.count(F.lit(1)).alias("_n"))
    counts = rows.groupBy(left, right).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return counts.join(a, left).join(b, right).crossJoin(F.broadcast(n)).select("u", (F.col("v") + F.col("_n")).alias("v"), "w")


def worker_firm_csv(spark: SparkSession, path: str) -> DataFrame:
    """The largest component (the one with the smallest id among equals) of a header-less CSV of worker, firm, ...: edges (u, v, w)."""
    rows = spark.read.csv(path).select(F.col("_c0").cast("long").alias("worker"), F.col("_c1").cast("long").alias("firm"))
    return largest_component(bipartite(rows.dropna(), "worker", "firm"))


def largest_component(edges: DataFrame) -> DataFrame:
    labels = components(edges, "u", "v")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max(F.struct("n", (-F.col("component")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("component"))
    return G.induced(edges, labels.join(F.broadcast(best), "component").select("id"))
