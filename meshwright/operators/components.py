"""Connected components by hooking and pointer jumping on contracted edges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidOption
from ..functions.kernel import smallest_members

#: Edges (16 bytes each) up to which one task finishes.
FEW = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; sets one only in local mode (tests), where there are no other machines, and fails elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise InvalidOption(option="spark.checkpoint.dir", reason="name a folder that all executors share")

        spark.conf.set("spark.checkpoint.dir", found := "file://" + tempfile.mkdtemp(prefix="meshwright-"))
    return found


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, is computed once, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what `written` wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _finished(edges: DataFrame) -> DataFrame:
    """(id, p): the smallest id that each endpoint reaches, from a checked number of edges in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
        a, b = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = smallest_members(len(names), where[: len(a)], where[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["id", "p"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "id long, p long")


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(id, component) for every endpoint of edges: component is the smallest id that edges reach.

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots and contracts
    the edges, so at most half of the nodes are left; a node with very many edges is only ever aggregated over.
    When no more than `few` edges are left, one task finishes; whatever their number, the result is the same.
    Null endpoints are no endpoints; repeated edges and loops change nothing. Ids are integers.
    """
    left = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null")
    left = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if left.count() <= few:
        return written(_finished(left).withColumnRenamed("p", "component"), "labels")
    labels = left.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    left = left.filter("a < b")
    while n := left.count():
        if n <= few:
            parent = _finished(left)
            return labels.join(parent.select(F.col("id").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("p")), "parents")
        more = True
        while more:  # each pass makes pointers eight times as long, until all are at roots
            for _ in range(3):
                up = parent.select(F.col("id").alias("p"), F.col("p").alias("q"))
                parent = parent.join(up, "p").select("id", F.col("p").alias("was"), F.col("q").alias("p"))
                more_rows, parent = parent, parent.select("id", "p")
            found = written(more_rows, "parents")
            more = not found.filter("was <> p").isEmpty()
            parent = found.select("id", "p")
        labels = written(labels.join(parent.select(F.col("id").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
        pa, pb = parent.select(F.col("id").alias("a"), F.col("p").alias("x")), parent.select(F.col("id").alias("b"), F.col("p").alias("y"))
        moved = left.join(pa, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = written(moved, "edges")
    return labels
