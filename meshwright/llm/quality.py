"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are code points (classes of 12 bits: every code point below 2048 has its own, all others share
the rest by a hash), so that all scripts count; an n-gram is one long, from which its context and its
shorter n-gram follow. Counts are taken from all trusted text but one fold, as a table sharded by n-gram;
continuation counts, discounts, and each n-gram's share of its context come from joins and aggregates of
those shards. The model is what was seen, and grows with the trusted text. While its checked size is
within a bound, a copy goes to each task and no text is shuffled; beyond it the distinct n-grams of blocks
of documents are joined with the shards of the model, and each block is scored from its own answers. Both
ways give the same perplexities. Thresholds are quantiles, by language, of the perplexities of the trusted
fold that the model has not seen, beside those of rows labelled bad.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free, present, written

BITS, OWN = 12, 2048
SYMBOLS = 1 << BITS
PAD = ord("\n")
#: Symbols that are looked at together; longer texts are cut, shorter ones joined.
PIECE = 1 << 18
#: n-grams of a model that is copied to each task, and what one takes there.
ENTRY = 16


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(points < OWN, points, OWN + ((points * 0x9E3779B1 & 0xFFFFFFFF) >> 21))


def grams(texts: Iterable[str], order: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-gram that ends at each symbol of the texts, and the number of its text, in pieces. A text is preceded by order - 1 line ends."""
    held: list[tuple[int, str]] = []
    size = 0

    def coded() -> tuple[np.ndarray, np.ndarray]:
        s = symbols("".join(x for _, x in held))
        code = np.zeros(len(s) - order + 1, np.int64)
        for k in range(order):
            code = (code << BITS) | s[k : k + len(code)]
        n = np.array([len(x) for _, x in held])
        starts = np.cumsum(n) - n
        lengths = n - order + 1
        where = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return code[where], np.repeat([i for i, _ in held], lengths)

    for i, text in enumerate(texts):
        for at in range(0, len(text), piece):
            before = text[max(0, at - order + 1) : at]
            held.append((i, "\n" * (order - 1 - len(before)) + before + text[at : at + piece]))
            size += len(held[-1][1])
            if size >= piece:
                yield coded()
                held, size = [], 0
    if held:
        yield coded()


def _texts(column: pa.Array) -> Iterator[str]:
    """The texts of a string or binary column, one at a time; null: empty."""
    return (x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "" for x in column)


def _counts(texts: DataFrame, order: int) -> DataFrame:
    """(gram, n), in partial sums of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["gram", "n"])

        for batch in batches:
            for codes, _ in grams(_texts(batch.column(0)), order):
                found, n = np.unique(codes, return_counts=True)
                held, where = np.unique(np.concatenate([held, found]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(held)).astype(np.int64)
                if len(held) > 2_000_000:
                    yield packed()
                    held, counts = held[:0], counts[:0]
        yield packed()

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts 1, 2 and more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = counts.agg(*(F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4))).first()
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.1 * k), float(k)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _tagged(gram: Column, k: int) -> Column:
    """An n-gram of k symbols, apart from those of other lengths."""
    return gram.bitwiseOR(F.lit(k << BITS * 5))


def train(texts: DataFrame, order: int = 5) -> DataFrame:
    """The model of texts(text binary), written: (code, share, back), one row for each n-gram of up to `order` symbols that was seen.

    share: its discounted share of its context; back: the weight of the shorter context after it. order: 5 at most.
    """
    tables = {order: written(_counts(texts, order), "counts")}
    for k in range(order - 1, 0, -1):  # continuation counts: how many symbols stand before
        tables[k] = written(tables[k + 1].groupBy((F.col("gram") % (1 << BITS * k)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "counts")
    found: DataFrame | None = None
    for k in range(1, order + 1):
        d = _discounts(tables[k])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = tables[k].select("gram", F.shiftright("gram", BITS).alias("context"), "n", cut.alias("cut"))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("back"))
        shares = rows.join(contexts, "context").select(_tagged(F.col("gram"), k).alias("code"), ((F.col("n") - F.col("cut")) / F.col("total")).cast("float").alias("share"), F.lit(None).cast("float").alias("back"))
        both = shares.unionByName(contexts.select(_tagged(F.col("context"), k - 1).alias("code"), F.lit(None).cast("float").alias("share"), F.col("back").cast("float").alias("back")))
        found = both if found is None else found.unionByName(both)
    model = found.groupBy("code").agg(F.coalesce(F.max("share"), F.lit(0.0)).cast("float").alias("share"), F.coalesce(F.max("back"), F.lit(1.0)).cast("float").alias("back"))
    return written(model, "model")


def probabilities(codes: np.ndarray, order: int, known: np.ndarray, share: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Of each n-gram of `order` symbols: the probability of its last symbol after the others. known: the model's codes, ascending."""

    def looked_up(wanted: np.ndarray, values: np.ndarray, otherwise: float) -> np.ndarray:
        different, where = np.unique(wanted, return_inverse=True)
        if not len(known):
            return np.full(len(wanted), otherwise)
        at = np.minimum(np.searchsorted(known, different), len(known) - 1)
        return np.where(known[at] == different, values[at].astype(np.float64), otherwise)[where]

    p = np.full(len(codes), 1 / SYMBOLS)
    for k in range(1, order + 1):
        gram = codes & ((1 << BITS * k) - 1)
        p = looked_up(gram | (k << BITS * 5), share, 0.0) + looked_up((gram >> BITS) | ((k - 1) << BITS * 5), back, 1.0) * p
    return p


def _perplexities(column: pa.Array, order: int, known: np.ndarray, share: np.ndarray, back: np.ndarray) -> pa.Array:
    """The mean negative log probability of each text's symbols; null for an empty one."""
    total, n = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for codes, rows in grams(_texts(column), order):
        different, where = np.unique(codes, return_inverse=True)
        total += np.bincount(rows, np.log(probabilities(different, order, known, share, back))[where], len(column))
        n += np.bincount(rows, minlength=len(column))
    return pa.array(-total / np.maximum(n, 1), pa.float64(), mask=n == 0)


def copied(model: DataFrame, most_bytes: int = 64 << 20) -> Broadcast | None:
    """A copy of the model for the tasks: its codes, ascending, shares and backs. None of a model of more than most_bytes."""
    if model.count() * ENTRY > most_bytes:
        return None
    table = model.toArrow().sort_by("code")
    return model.sparkSession.sparkContext.broadcast(tuple(np.asarray(table.column(c)) for c in ("code", "share", "back")))


def scored(docs: DataFrame, model: DataFrame, order: int = 5, text: str = "text", key: str = "doc_id", into: str = "log_perplexity", most_bytes: int = 64 << 20, block_rows: int = 8192, shared: Broadcast | None = None) -> DataFrame:
    """docs with the mean negative log probability of the text's symbols; null where there is no text.

    A model of up to most_bytes is copied to the tasks, unless shared is such a copy already; of a larger one each block of
    about block_rows documents gets what it asks for.
    """
    docs = docs.drop(into)
    where, names = docs.columns.index(text), docs.columns
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    shared = shared or copied(model, most_bytes)
    if shared:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, _perplexities(batch.column(where), order, *shared.value)], names=[*names, into])
            pa.default_memory_pool().release_unused()

        return docs.mapInArrow(run, schema)

    blocks = max(1, -(-docs.count() // block_rows))
    rows = docs.select(F.pmod(F.xxhash64(key, text), F.lit(blocks)).alias("block"), F.struct(*docs.columns).alias("row"), F.col(text).cast("binary").alias("text"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.asarray(batch.column(0))
            for b in np.unique(block).tolist():
                held = [codes for codes, _ in grams(_texts(batch.column(1).filter(pa.array(block == b))), order)]
                top = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
                parts = [(top & ((1 << BITS * k) - 1)) | (k << BITS * 5) for k in range(1, order + 1)] + [((top & ((1 << BITS * k) - 1)) >> BITS) | ((k - 1) << BITS * 5) for k in range(1, order + 1)]
                codes = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), b)), pa.array(codes)], names=["block", "code"])

    requests = rows.select("block", "text").repartition("block").mapInArrow(asked, "block long, code long").distinct()
    none = F.lit(None)
    answers = requests.join(model, "code").select("block", F.lit(0).alias("role"), none.cast(rows.schema["row"].dataType).alias("row"), none.cast("binary").alias("text"), "code", "share", "back")
    every = answers.unionByName(rows.select("block", F.lit(1).alias("role"), "row", "text", none.cast("long").alias("code"), none.cast("float").alias("share"), none.cast("float").alias("back")))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, table = None, [], None
        for batch in batches:
            block, role = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (role[1:] != role[:-1])))
            for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
                part = batch.slice(a, z - a)
                if block[a] != at:
                    at, held, table = block[a], [], None
                if role[a] == 0:
                    held.append(part.select(["code", "share", "back"]))
                    continue
                if table is None:
                    found = pa.Table.from_batches(held).sort_by("code") if held else None
                    table = tuple(np.asarray(found.column(c)) for c in ("code", "share", "back")) if held else (np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32))
                row = part.column(2)
                yield pa.RecordBatch.from_arrays([*row.flatten(), _perplexities(part.column(3), order, *table)], names=[*names, into])

    return every.repartition("block").sortWithinPartitions("block", "role").mapInArrow(answered, schema)


def thresholds(held_out: DataFrame, bad: DataFrame, quantile: float, least: int) -> DataFrame:
    """(lang, threshold): the quantile of log_perplexity (in steps of 0.001) of held_out in a language with `least` rows or more; null: of all rows.

    bad: rows labelled toxic or of low quality. The cut lies halfway from the quantile to the next of them above it,
    if any: that lets in none of them that the quantile does not, and where they are dense it is the quantile.
    """
    from pyspark.sql import Window

    def binned(rows: DataFrame) -> DataFrame:
        return rows.filter("log_perplexity is not null").groupBy("lang", F.round("log_perplexity", 3).alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def of(rows: DataFrame, above: DataFrame, by: list[str]) -> DataFrame:
        up = Window.partitionBy(*by).orderBy("v")
        rows = rows.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
        cut = rows.filter(F.col("upto") >= F.lit(quantile) * F.col("total")).groupBy(*by, "total").agg(F.min("v").alias("cut"))
        after = cut.join(above.withColumnRenamed("v", "bad"), by, "left").groupBy(*by, "total", "cut").agg(F.min(F.when(F.col("bad") > F.col("cut"), F.col("bad"))).alias("bad"))
        return after.select(*by, "total", ((F.col("cut") + F.coalesce("bad", "cut")) / 2).alias("threshold"))

    bins, above = binned(held_out), binned(bad)
    one = lambda rows: rows.groupBy("v").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    every = of(one(bins), one(above).select("one", "v"), ["one"]).select(F.lit(None).cast("string").alias("lang"), "threshold")
    return of(bins.filter("lang is not null"), above.select("lang", "v"), ["lang"]).filter(F.col("total") >= least).select("lang", "threshold").unionByName(every)


def judge(docs: DataFrame, labels: DataFrame, order: int = 5, quantile: float = 0.98, least: int = 50, folds: int = 10, most_languages: int = 10_000, most_bytes: int = 64 << 20, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """docs with log_perplexity, threshold and keep (not above the threshold of the row's language).

    Trusted text: all rows of docs whose key labels calls of good quality and not toxic. One of `folds` parts of
    it (by a hash of the key) is not trained on and gives the thresholds, with the other labelled rows (see
    thresholds); a language with fewer than `least` such rows, or null, takes the threshold of all.
    Null and empty texts have no perplexity and are kept, and without trusted text every row is. Equal rows get equal results; an empty table gives an empty result.
    """
    docs = docs.drop("log_perplexity", "threshold", "keep")
    good = F.coalesce(F.expr("quality = 1 and coalesce(toxic, 0) = 0"), F.lit(False))
    called = labels.filter("quality in (0, 1) or toxic = 1").groupBy(F.col("doc_id").alias("_id")).agg(F.max(good).alias("good"))
    rows = docs.select(F.col(key).alias("_id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    fold = F.pmod(F.xxhash64("_id"), F.lit(folds))
    trusted = called.filter("good").select("_id")
    model = train(present(rows.filter(fold != 0), trusted, "_id").join(trusted, "_id").select("text"), order)
    shared = copied(model, most_bytes)  # once for both tables that are scored
    asked = called.filter((fold == 0) | ~F.col("good"))  # scored before they are joined, so that no text is shuffled
    seen = written(scored(present(rows, asked, "_id"), model, order, key="_id", most_bytes=most_bytes, shared=shared).select("_id", "lang", "log_perplexity").join(asked, "_id"), "held_out")
    limits = written(thresholds(seen.filter("good"), seen.filter("not good"), quantile, least), "thresholds")
    every = limits.filter("lang is null").first()
    of, limit = free(docs, "of"), free(docs, "limit")
    limits = limits.filter("lang is not null").select(F.col("lang").alias(of), F.col("threshold").alias(limit))
    if limits.count() <= most_languages:  # checked: else the rows are shuffled by language
        limits = F.broadcast(limits)
    out = scored(docs, model, order, text, key, most_bytes=most_bytes, shared=shared).join(limits, F.col(lang) == F.col(of), "left")
    cut = F.coalesce(limit, F.lit(every["threshold"] if every else None).cast("double"))
    return out.select(*docs.columns, "log_perplexity", cut.alias("threshold"), F.coalesce(F.col("log_perplexity") <= cut, F.lit(True)).alias("keep"))
