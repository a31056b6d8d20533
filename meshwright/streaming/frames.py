"""Graphs whose weights arrive as a stream of frames over a fixed topology."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import assemble


def stream_frames(weights: DataFrame, topology: DataFrame, each: Callable[[int, DataFrame], None], checkpoint: str):
    """Starts a query that hands every complete micro-batch of (frame, input_idx, w) to each(batch id, assembled edges)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        each(batch_id, assemble(topology, batch))

    return weights.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def windowed_degrees(edges: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """From a stream of (time, u, v, w): weighted degrees by window, with a watermark for late edges."""
    ends = edges.withWatermark(time, late).select(time, F.explode(F.array("u", "v")).alias("id"), "w")
    return ends.groupBy(F.window(time, size), "id").agg(F.sum("w").alias("degree"))
