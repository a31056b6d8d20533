"""Mixing sources to target weights, with DataFrame functions only.

Each source is cut into `blocks` blocks by a hash of the row's key. A source whose target is r times
its size gives floor(r) copies of every block, and of the rest the first blocks of a fixed random
order that fit; the block that the target cuts is taken up to that place. The units (source, block,
copy) are dealt to the output shards by a splitting tree: each node halves the exact block quotas of
its sources by drawing half of its units without replacement, so that each half's counts by source
are multivariate hypergeometric; after log2(shards) levels a leaf is a shard. Units are disjoint, and
a row's copies are the units of its block that the leaves hold, less one for rows behind the place of the
cut. Rows are shuffled within their shard by a hash. All tables but the rows have at most sources * blocks
* max_repeats rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free


def _code(*parts: Column | str) -> Column:
    """A fixed random order: the MD5 of the parts, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """From (source, words): source, source_size, target. Weights repeat over the sources by code point, null last.

    Targets share the sum of all sizes by weight; none is above max_repeats times its source's size: with
    sources in order of cap / weight, one is capped if the share left for it and all later ones exceeds its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    t = sizes.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("weight", weight)
    t = t.withColumn("ratio", max_repeats * F.col("source_size") / F.col("weight"))
    t = t.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum(max_repeats * F.col("source_size")).over(before), F.lit(0)))
    t = t.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("capped", F.col("level") > F.col("ratio"))
    t = t.withColumn("place", F.row_number().over(by_ratio))
    water = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(whole)["level"]
    target = F.when(F.col("capped"), (max_repeats * F.col("source_size")).cast("double")).otherwise(water * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def split_shards(units: DataFrame, shards: int, seed: str) -> DataFrame:
    """Adds `shard` to units(source, block, copy): the leaf of the splitting tree that draws the unit. shards: a power of two."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    t = units.withColumn("shard", F.lit(0))
    for level in range(shards.bit_length() - 1):
        drawn = Window.partitionBy("shard").orderBy(_code(seed, f"split{level}", F.coalesce("source", F.lit("\0")), F.col("block"), F.col("copy")))
        half = F.count(F.lit(1)).over(Window.partitionBy("shard")) / 2
        t = t.withColumn("shard", F.col("shard") * 2 + F.when(F.row_number().over(drawn) <= half, 0).otherwise(1))
    return t


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, blocks: int = 1024, shards: int = 16, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with size (words of the text), source_size, target, copies (how often the mix takes the row) and shards (of each copy).

    Null and empty texts have size 0; a null source is a source, the last one; rows are told apart by key,
    equal keys in one source lie in one block and rows with equal keys and sizes are interchangeable. The
    words taken of a source differ from its target by at most one row, copies are at most max_repeats, and
    the same rows give the same result in any order and partitioning. An empty table gives an empty result.
    """
    made = ["size", "source_size", "target", "copies", "shards"]
    if clash := [c for c in docs.columns if c in made]:
        docs = docs.drop(*clash)
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    m = lambda c: prefix + c
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    code = _code(seed, F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.withColumns({m("source"): F.col(source), "size": size, m("code"): code}).withColumn(m("block"), F.conv(F.substring(m("code"), 1, 8), 16, 10).cast("long") % blocks)
    by_block = rows.groupBy(F.col(m("source")).alias("source"), F.col(m("block")).alias("block")).agg(F.sum("size").alias("words"))
    targets = source_targets(by_block, weights, max_repeats)
    ratio = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("int")
    t = by_block.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("whole", ratio)
    order = Window.partitionBy("source").orderBy(_code(seed, "block", F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("room", F.col("target") - F.col("whole") * F.col("source_size") - F.coalesce(F.sum("words").over(order), F.lit(0)))
    t = t.withColumn("most", F.col("whole") + F.when((F.col("whole") < max_repeats) & (F.col("room") > 0), 1).otherwise(0))
    units = t.filter("most > 0").select("source", "block", F.explode(F.sequence(F.lit(1), "most")).alias("copy"))
    placed = split_shards(units, shards, seed).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard")))["shard"].alias("shards"))
    placed = placed.select(F.col("source").alias("_p_source"), F.col("block").alias("_p_block"), "shards")
    joined = t.withColumnsRenamed({"source": m("t_source"), "block": m("t_block")}).join(placed, F.col(m("t_source")).eqNullSafe(F.col("_p_source")) & (F.col(m("t_block")) == F.col("_p_block")), "left")
    plan = joined.select(m("t_source"), m("t_block"), "source_size", "target", F.col("whole").alias(m("whole")), F.col("room").alias(m("room")), F.col("words").alias(m("words")), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    out = rows.join(plan, F.col(m("source")).eqNullSafe(F.col(m("t_source"))) & (F.col(m("block")) == F.col(m("t_block"))))
    cut = (F.col(m("room")) > 0) & (F.col(m("room")) < F.col(m("words"))) & (F.col(m("whole")) < max_repeats)
    plain = out.filter(~cut).withColumn("copies", F.size("shards"))
    inside = Window.partitionBy(m("source"), m("block")).orderBy(m("code"), "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    partial = out.filter(cut).withColumn("copies", F.size("shards") - F.when(middle <= F.col(m("room")), 0).otherwise(1))
    both = plain.unionByName(partial)
    return both.withColumn("shards", F.slice("shards", F.lit(1), F.col("copies"))).select(*docs.columns, *made)


def mixed_rows(mixed: DataFrame, columns: list[str], shards: int = 16, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """A row for each copy that the mix takes, by shard, shuffled within it."""
    copy, shard = free(mixed, "_copy"), free(mixed, "_shard")
    rows = mixed.select(*columns, F.posexplode("shards").alias(copy, shard))
    rows = rows.repartition(shards, shard).sortWithinPartitions(shard, _code(seed, "row", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(copy)))
    return rows.select(*columns)
