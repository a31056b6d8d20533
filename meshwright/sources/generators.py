"""Deterministic graph families, vectors and panels, as column expressions over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def weight(seed: Column) -> Column:
    """0.5 + (a linear congruence of the seed mod 1024) / 512; only the seed's last ten bits matter."""
    return F.lit(0.5) + F.pmod(F.pmod(seed, F.lit(1024)) * 1103515245 + 12345, F.lit(1024)) / 512


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(n - 1, 0)).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), weight(F.col("id")).alias("w"))


def grid(spark: SparkSession, n: int, offset: int = 0) -> DataFrame:
    """n vertices row by row in a square of the least width that holds them."""
    width = int((n - 1) ** 0.5) + 1 if n else 1
    while width * width < n:
        width += 1
    i = F.col("id")
    right = F.when((i % width + 1 < width) & (i + 1 < n), F.struct((i + 1).alias("t"), weight(i + offset).alias("w")))
    down = F.when(i + width < n, F.struct((i + width).alias("t"), weight((i + offset) * 31).alias("w")))
    return spark.range(n).select("id", F.explode(F.filter(F.array(right, down), lambda e: e.isNotNull())).alias("e")).select((i + offset).alias("u"), (F.col("e.t") + offset).alias("v"), F.col("e.w").alias("w"))


def worker_firm(spark: SparkSession, n: int, links: int = 3) -> DataFrame:
    """The first half are workers, each with `links` edges to firms; an edge may repeat."""
    workers = n // 2
    firms = n - workers
    i, k = F.col("id"), F.col("k")
    firm = F.when(k == 0, i % firms).when(k == 1, (i + 1) % firms).otherwise(((2 * k + 1) * i + 17 * k + 3) % firms)
    rows = spark.range(workers).select("id", F.explode(F.sequence(F.lit(0), F.lit(links - 1))).alias("k"))
    return rows.select(i.alias("u"), (firm + workers).alias("v"), (F.lit(0.25) + ((i + 7 * k) % 23) / 16).alias("w"))


def weak_community(spark: SparkSession, n: int, communities: int = 16) -> DataFrame:
    """Grids of nearly equal size, each joined to the next by one edge of weight 1."""
    m = min(communities, n)
    starts = [k * n // m for k in range(m + 1)] if m else []
    out = spark.createDataFrame([(b - 1, b, 1.0) for b in starts[1:-1]], "u long, v long, w double")
    for a, b in zip(starts, starts[1:]):
        out = out.unionByName(grid(spark, b - a, a))
    return out


def truth(spark: SparkSession, n: int, count: int = 1) -> DataFrame:
    """(rhs_id, id, val): known solutions with mean 0 for each rhs_id."""
    i, r = F.col("id"), F.col("rhs_id")
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("rhs_id"))
    value = ((i * 17 + r * 31) % 257 - 128) / 37 + ((i * 43 + r * 19) % 101 - 50) / 113
    raw = rows.select("rhs_id", "id", value.alias("val"))
    mean = raw.groupBy("rhs_id").agg(F.avg("val").alias("m"))
    return raw.join(F.broadcast(mean), "rhs_id").select("rhs_id", "id", (F.col("val") - F.col("m")).alias("val"))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("u"), ((F.col("id") + 1) % n).alias("v"), weight(F.col("id")).alias("w"))


def complete(spark: SparkSession, n: int, w: float = 1.0, offset: int = 0) -> DataFrame:
    rows = spark.range(max(n - 1, 0)).select((F.col("id") + offset).alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("t"))
    return rows.select("u", (F.col("t") + offset).alias("v"), F.lit(w).alias("w"))


def barbell(spark: SparkSession, n: int, bridge: float = 1e-3) -> DataFrame:
    """Two complete graphs of n vertices joined by one weak edge."""
    link = spark.createDataFrame([(n - 1, n, bridge)], "u long, v long, w double")
    return complete(spark, n).unionByName(complete(spark, n, 1.0, n)).unionByName(link)


def lollipop(spark: SparkSession, n: int, tail: int) -> DataFrame:
    """A complete graph of n vertices with a path of `tail` more."""
    rest = spark.range(tail).select((F.col("id") + n - 1).alias("u"), (F.col("id") + n).alias("v"), F.lit(1.0).alias("w"))
    return complete(spark, n).unionByName(rest)


def disconnected(spark: SparkSession, length: int, pairs: int, isolates: int = 0) -> tuple[DataFrame, DataFrame]:
    """A unit path, then pairs, then isolates: edges and ids."""
    a = spark.range(max(length - 1, 0)).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    b = spark.range(pairs).select((2 * F.col("id") + length).alias("u"), (2 * F.col("id") + length + 1).alias("v"))
    return a.unionByName(b).withColumn("w", F.lit(1.0)), spark.range(length + 2 * pairs + isolates)


def frames(topology: DataFrame, count: int, change: float) -> DataFrame:
    """(frame, input_idx, w): weights over a fixed topology, each frame's a factor 1 +- change of the one before, by turns."""
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("frame")
    rows = topology.select("input_idx", k)
    w = weight(F.col("input_idx")) * F.when((F.col("frame") + F.col("input_idx")) % 2 == 0, 1 + change * F.col("frame")).otherwise(1 / (1 + change * F.col("frame")))
    return rows.select("frame", "input_idx", w.alias("w"))


def panel(spark: SparkSession, people: int, years: int = 6, firms: int = 100, move: float = 0.1, seed: int = 1) -> DataFrame:
    """(obs, a, b, t, w, y, x1): people who stay with a firm or move to a random one each year."""
    u = lambda *salt: F.pmod(F.xxhash64("a", *salt, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    rows = spark.range(people).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(years - 1))).alias("t"))
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.col("t")), lambda s: (s == 0) | (F.pmod(F.xxhash64("a", s, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) < move)))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("a", last, F.lit(seed + 1)), F.lit(firms)))
    y = F.sin(F.col("a")) + F.cos(F.col("b") * 3) + u("t", F.lit(7))
    return rows.select((F.col("a") * years + F.col("t")).alias("obs"), "a", "b", "t", F.lit(1.0).alias("w"), y.alias("y"), u("t", F.lit(9)).alias("x1"))
