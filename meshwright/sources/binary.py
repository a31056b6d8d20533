"""A Spark data source for two little-endian binary formats: graphs, and bundles of vectors.

Fixed values of the formats:
- a graph: the magic CMGGRPH1, vertex count and edge count as u64, then (u64, u64, f64) for each edge;
- vectors: the magic CMGVEC01, length and count as u64, then all values as f64, one vector after the other.

Reading: option path (a file that all executors see), kind graph or vectors, partitions. Each partition
reads its own range of records. `write_graph` and `write_vectors` make such files, one writer each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GRAPH, VECTORS = b"CMGGRPH1", b"CMGVEC01"
EDGE = np.dtype([("u", "<u8"), ("v", "<u8"), ("w", "<f8")])


class _Range(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        super().__init__((first, end))
        self.first, self.end = first, end


def header(path: str) -> tuple[bytes, int, int]:
    with open(path, "rb") as f:
        magic, a, b = struct.unpack("<8sQQ", f.read(24))
    if magic not in (GRAPH, VECTORS):
        raise ValueError(f"{path} is neither a graph nor a bundle of vectors")
    return magic, a, b


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.magic, self.a, self.b = header(self.path)

    def partitions(self) -> list[_Range]:
        n = self.b if self.magic == GRAPH else self.a * self.b
        cut = [k * n // self.parts for k in range(self.parts + 1)]
        return [_Range(x, y) for x, y in zip(cut, cut[1:]) if y > x] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kind = EDGE if self.magic == GRAPH else np.dtype("<f8")
        for at in range(part.first, part.end, 1 << 16):
            n = min(1 << 16, part.end - at)
            x = np.fromfile(self.path, kind, n, offset=24 + at * kind.itemsize)
            if len(x) < n:
                raise ValueError(f"{self.path} is cut short")
            if self.magic == GRAPH:
                yield pa.RecordBatch.from_arrays([pa.array(x["u"].astype(np.int64)), pa.array(x["v"].astype(np.int64)), pa.array(x["w"].copy())], names=["u", "v", "w"])
            else:
                k = np.arange(at, at + n)
                yield pa.RecordBatch.from_arrays([pa.array((k // self.a).astype(np.int32)), pa.array(k % self.a), pa.array(x)], names=["rhs_id", "id", "val"])


class GraphBinary(DataSource):
    """spark.dataSource.register(GraphBinary); spark.read.format("graphbin").option("path", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "graphbin"

    def schema(self) -> str:
        return "u long, v long, w double" if header(self.options["path"])[0] == GRAPH else "rhs_id int, id long, val double"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def _atomic(path: str, chunks: Iterator[bytes]) -> None:
    part = Path(f"{path}.part")
    with part.open("wb") as f:
        for c in chunks:
            f.write(c)
    part.replace(path)


def write_graph(path: str, vertices: int, edges: DataFrame) -> None:
    """Sorted by (u, v); rows pass the driver in Arrow batches, the file appears whole or not at all."""
    n = edges.count()

    def chunks() -> Iterator[bytes]:
        yield struct.pack("<8sQQ", GRAPH, vertices, n)
        for batch in edges.orderBy("u", "v").select("u", "v", "w").toArrow().to_batches():
            out = np.empty(batch.num_rows, EDGE)
            for c in "uvw":
                out[c] = np.asarray(batch.column(c))
            yield out.tobytes()

    _atomic(path, chunks())


def write_vectors(path: str, vectors: DataFrame) -> None:
    """From (rhs_id, id, val) with ids 0..n-1 for each rhs_id."""
    t = vectors.orderBy("rhs_id", "id").toArrow()
    count = len(np.unique(np.asarray(t.column("rhs_id"))))
    _atomic(path, iter([struct.pack("<8sQQ", VECTORS, t.num_rows // max(count, 1), count), np.asarray(t.column("val"), "<f8").tobytes()]))
