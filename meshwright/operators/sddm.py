"""Symmetric diagonally dominant matrices with non-positive off-diagonals, solved as a graph with one more vertex.

A matrix is diag(i, d) and off(i, j, a) with a <= 0, each unordered pair once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _refuse


def canonical(diag: DataFrame, off: DataFrame) -> tuple[DataFrame, DataFrame]:
    """diag(i, d) and off(i, j, a), i < j: zeros dropped, duplicates summed, signs and dominance checked when read."""
    bad = F.coalesce(_refuse(F.col("a") > 0, "PositiveOffDiagonal:", "i", "j", "a"), F.col("a"))
    pairs = off.filter("a <> 0").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), bad.alias("a")).groupBy("i", "j").agg(F.sum("a").alias("a"))
    e = excess(diag, pairs)
    checked = F.coalesce(_refuse(F.col("d") < 0, "NegativeDiagonal:", "i", "d"), _refuse(F.col("d") < F.col("held"), "NotDominant: row", "i"), F.col("d"))
    return e.select("i", checked.alias("d")), pairs


def excess(diag: DataFrame, off: DataFrame) -> DataFrame:
    """(i, d, held, excess): the sum of a row's off-diagonal sizes, and what the diagonal has beyond it."""
    ends = off.select(F.explode(F.array("i", "j")).alias("i"), F.abs("a").alias("x")).groupBy("i").agg(F.sum("x").alias("held"))
    held = F.coalesce("held", F.lit(0.0))
    return diag.join(ends, "i", "left").select("i", "d", held.alias("held"), F.greatest(F.col("d") - held, F.lit(0.0)).alias("excess"))


def from_dense(entries: DataFrame, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """From all entries (i, j, value): mirrored ones must be close, and are averaged."""
    a, b = entries.filter("i < j"), entries.filter("i > j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("other"))
    far = F.abs(F.col("value") - F.col("other")) > tolerance * F.greatest(F.lit(1.0), F.abs("value"), F.abs("other"))
    off = a.join(b, ["i", "j"]).select("i", "j", F.coalesce(_refuse(far, "NotSymmetric:", "i", "j"), (F.col("value") + F.col("other")) / 2).alias("a"))
    return canonical(entries.filter("i = j").select("i", F.col("value").alias("d")), off)


def matvec(diag: DataFrame, off: DataFrame, x: DataFrame) -> DataFrame:
    rows = off.select("i", "j", "a").unionByName(off.select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    s = rows.join(x.select(F.col("id").alias("j"), F.col("val").alias("_x")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("a") * F.col("_x")).alias("_s"))
    return diag.select(F.col("i").alias("id"), "d").join(x, "id").join(s, "id", "left").select("id", (F.col("d") * F.col("val") + F.coalesce("_s", F.lit(0.0))).alias("val"))


def augment(diag: DataFrame, off: DataFrame, extra: int) -> DataFrame:
    """Edges (u, v, w): the off-diagonals, and each row's excess as an edge to the vertex `extra`."""
    e = excess(diag, off).filter("excess > 0").select(F.col("i").alias("u"), F.lit(extra).cast("long").alias("v"), F.col("excess").alias("w"))
    return off.filter("a <> 0").select(F.col("i").alias("u"), F.col("j").alias("v"), (-F.col("a")).alias("w")).unionByName(e)


def lift(b: DataFrame, extra: int) -> DataFrame:
    """b with minus its sum at the vertex `extra`."""
    return b.unionByName(b.agg((-F.sum("val")).alias("val")).select(F.lit(extra).cast("long").alias("id"), "val"))


def extract(x: DataFrame, extra: int) -> DataFrame:
    """x less its value at the vertex `extra`, without that vertex."""
    ground = x.filter(F.col("id") == extra).select(F.col("val").alias("_g"))
    return x.filter(F.col("id") != extra).crossJoin(F.broadcast(ground.limit(1))).select("id", (F.col("val") - F.col("_g")).alias("val"))
