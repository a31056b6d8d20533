"""op4: a part of more rows than are held before they are made fewer."""

from pyspark.sql import functions as F

from meshwright.llm.jaccard import _pairs


def test_pairs_of_a_part_that_is_made_smaller(spark):
    n = 430_000
    i = F.col("id")
    token = F.when(i < 60, F.lit(7)).otherwise(i + 1000)  # 60 rows of 3 clusters share a token, the others meet none
    cluster = F.when(i < 60, i % 3).otherwise(i)
    rows = spark.range(n).select(F.lit(99).cast("long").alias("part"), token.cast("long").alias("token"), cluster.alias("cluster"), *(F.lit(10).alias(c) for c in ("low", "high")), F.lit(1).alias("need"), F.lit(-1).cast("long").alias("group"), *(F.lit(-1).alias(c) for c in ("at", "length")))
    got = _pairs(rows.coalesce(1).sortWithinPartitions("part"), 85).collect()
    assert sorted((r["a"], r["b"], r["shared"]) for r in got) == [(0, 1, 1), (0, 2, 1), (1, 2, 1)]
