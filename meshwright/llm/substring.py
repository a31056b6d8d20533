"""Substring dedup: runs of `window` words that a document with a smaller id holds too are removed.

Suffixes are sampled and grouped by content. The least hash among the `prefix`-word runs inside a
window is the same wherever the window stands, so equal windows meet under that run, their common
prefix for grouping; a run that only one document has cannot stand in a repeated window, and all
windows under it drop out before anything but the run's hash has moved. What is left are stretches
of consecutive windows under one prefix. Equal stretches are one node with the smallest document id;
the distinct stretches under one prefix make a subtree, sorted by their whole window hash: a class of
equal windows is an internal node at depth `window`, and neighbouring such nodes with one smallest
document join into maximal repeats. Prefixes with more than max_group distinct stretches are
lengthened to whole windows, which are aggregated without ever being one task's group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import parts, runs, sliding, word_hashes


def _windows(words: np.ndarray, first: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the prefix-word runs at each word, the least of them in the window at each word, and whether that window lies in one text."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = runs(words, np.arange(n - prefix + 1), prefix)
    least = sliding(grams, window - prefix + 1, np.minimum)
    text = np.searchsorted(first, np.arange(n), side="right")
    return grams, least, text[: n - window + 1] == text[window - 1 :]


def _prefixes(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(doc, prefix) for the least run of every window, each at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in parts(batch.column(1)):
                words, first = word_hashes(data, offsets)
                _, least, inside = _windows(words, first, window, prefix)
                at = np.flatnonzero(inside)
                value = least[at]
                text = np.searchsorted(first, at, side="right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text[new] + i)), pa.array(value[new].view(np.int64))], names=["doc", "prefix"])

    return docs.mapInArrow(run, "doc long, prefix long")


def _stretches(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """From (doc, text, wanted prefixes): for each stretch of windows under one wanted prefix its first word and the windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            ids = batch.column(0)
            for i, j, data, offsets in parts(batch.column(1)):
                words, first = word_hashes(data, offsets)
                _, least, inside = _windows(words, first, window, prefix)
                if not len(least):
                    continue
                hashes = runs(words, np.arange(len(words) - window + 1), window).view(np.int64)
                doc, begin, found, lengths, values = [], [], [], [], []
                for k in range(i, j):
                    a, b = int(first[k - i]), int(first[k - i + 1]) - window + 1
                    if b <= a:
                        continue
                    own = least[a:b].view(np.int64)
                    wanted = np.sort(np.asarray(batch.column(2)[k].values))
                    hit = np.zeros(b - a, bool) if not len(wanted) else wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
                    edge = np.ones(b - a, bool)
                    edge[1:] = own[1:] != own[:-1]
                    starts = np.flatnonzero(edge)
                    ends = np.append(starts[1:], b - a)
                    keep = hit[starts]
                    starts, ends = starts[keep], ends[keep]
                    doc.append(np.full(len(starts), k))
                    begin.append(starts)
                    found.append(own[starts])
                    lengths.append(ends - starts)
                    values.append(hashes[a:b][hit])
                if doc:
                    edges = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(found)), pa.array(np.concatenate(begin).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(values)))], names=["doc", "prefix", "begin", "windows"])

    return docs.mapInArrow(run, "doc long, prefix long, begin int, windows array<long>")


def _subtrees(stretches: DataFrame) -> DataFrame:
    """From distinct stretches (prefix, node, doc, windows), all of a prefix in one partition and sorted by it: the repeats in each,
    as (prefix, node, repeats: array of (from, to, doc)) where windows from..to-1 also start in doc, the smallest one."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        lists = table.column("windows").combine_chunks()
        flat = np.asarray(lists.flatten())
        offsets = np.asarray(lists.offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        docs, group = np.asarray(table.column("doc")), np.asarray(table.column("prefix"))
        order = np.lexsort((flat, group[row]))
        f, g, d = flat[order], group[row][order], docs[row][order]
        edge = np.ones(len(f), bool)
        edge[1:] = (f[1:] != f[:-1]) | (g[1:] != g[:-1])
        starts = np.flatnonzero(edge)
        smallest = np.empty(len(f), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(f))))
        cut = np.ones(len(f), bool)
        cut[1:] = (smallest[1:] != smallest[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(f))
        base = offsets[row[begin]]
        values = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), pa.array(smallest[begin])], names=["from", "to", "doc"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, offsets).astype(np.int32)), values)
        return pa.RecordBatch.from_arrays([table.column("prefix").combine_chunks(), table.column("node").combine_chunks(), lists], names=["prefix", "node", "repeats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column("prefix"))
            cut = int(np.searchsorted(keys, keys[-1])) if (keys[:-1] <= keys[1:]).all() else 0  # where the last prefix begins
            if cut or (held and np.asarray(held[-1].column("prefix"))[-1] != keys[-1]):
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield solve(pa.Table.from_batches(held))

    return stretches.mapInArrow(run, "prefix long, node long, repeats array<struct<from:int,to:int,doc:long>>")


def repeated_spans(docs: DataFrame, window: int = 50, prefix: int = 12, max_group: int = 50_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, spans): the ranges of words, as array of (from, to), that stand in windows which also start in a document of smaller id."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    prefixes = written(_prefixes(rows.filter(F.col("doc").isNotNull()), window, prefix), "prefixes")
    shared = prefixes.groupBy("prefix").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("prefix")
    wanted = prefixes.join(shared, "prefix").groupBy(F.col("doc").alias("d")).agg(F.collect_set("prefix").alias("wanted"))
    candidates = rows.join(wanted, F.col("doc") == F.col("d"), "left").select("doc", "text", "wanted")
    found = written(_stretches(candidates, window, prefix).withColumn("node", F.xxhash64("windows")), "stretches")
    nodes = found.groupBy("prefix", "node").agg(F.min("doc").alias("doc"), F.first("windows").alias("windows"))
    large = nodes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_group).select("prefix", F.lit(True).alias("large"))
    nodes = written(nodes.join(large, "prefix", "left"), "nodes")
    small = nodes.filter("large is null").select("prefix", "node", "doc", "windows").repartition("prefix").sortWithinPartitions("prefix")
    repeats = _subtrees(small)
    apart = nodes.filter("large").select("prefix", "node", "doc", F.posexplode("windows").alias("at", "window"))
    least = apart.groupBy("prefix", "window").agg(F.min("doc").alias("least"))
    lengthened = apart.join(least, ["prefix", "window"]).select("prefix", "node", F.array(F.struct(F.col("at").alias("from"), (F.col("at") + 1).alias("to"), F.col("least").alias("doc"))).alias("repeats"))
    spans = found.select("doc", "prefix", "node", "begin").join(repeats.unionByName(lengthened), ["prefix", "node"])
    later = F.filter("repeats", lambda r: r["doc"] < F.col("doc"))
    spans = spans.select("doc", F.transform(later, lambda r: F.struct((F.col("begin") + r["from"]).alias("from"), (F.col("begin") + r["to"] + window - 1).alias("to"))).alias("spans")).filter(F.size("spans") > 0)
    return spans.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = 50, prefix: int = 12, max_group: int = 50_000, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 and with with_text kept, the kept words joined by one space.

    A word goes if a window of `window` consecutive words covers it that also starts in a row with a smaller
    key; windows are judged on the input. Null and empty texts have no words; rows with equal keys do not take
    words from each other; rows with a null key neither lose nor take any. keys are integers. Texts shorter
    than a window stay. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, window, prefix, max_group, text, key)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    joined = rows.join(spans.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"), "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, hashes, kept = [], [], [], []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (value.as_py() or b"").split()
                n.append(len(words))
                if spans.is_valid:
                    begin, end = (np.asarray(spans.values.field(k)) for k in (0, 1))
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, begin, 1)
                    np.add.at(change, end, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                removed.append(n[-1] - len(words))
                joined = b" ".join(words)
                hashes.append(sha256(joined).hexdigest())
                if with_text:
                    kept.append(joined.decode("utf-8", "replace"))
            more = [pa.array(kept, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()), *more], names=[key, "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])])

    return joined.mapInArrow(run, f"`{key}` long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
