"""Jaccard self-join of shingle sets by adaptive multi-match prefixes, down to the classes of linked documents.

All sets are ordered alike: by an estimate of how many documents hold a shingle, rare first, then by
hash. Two sets of n shingles with Jaccard similarity t or more share l of the first n - ceil(t n) + l
ones, for any l. Each document takes the l that makes its estimated cost least: a longer prefix is more
to move, but a pair must share more of it, the smaller l of the two, before it is verified.

Equal sets are one class. A first verified round links each document to a typical document of its
min-hash buckets, its pivot, which joins large groups of copies by a linear number of comparisons. The
prefix join then runs between the clusters found: what is counted for a pair of clusters is no less than
for any pair of their documents, so no link between different clusters is lost, and pairs inside one are
never listed. Frequent tokens are dealt to tasks by the smallest document that holds them, so that near copies
meet in one task, which leaves out a pair that the tokens it has not seen cannot bring to its count. Where a cluster is one document, a shared token counts only if it lies in the prefix that the
two sizes ask for: of n and m shingles a link shares o >= t (n + m) / (1 + t), more than t n, and the first
n - o + l and m - o + l have l in common.

Pairs with one pivot p are left to a third round. Let D(x) be the symmetric difference of x and p. Sets
x and y link only if |x ^ y| <= (1 - t) / (1 + t) (|x| + |y|), and |D(x) & D(y)| is half of |D(x)| +
|D(y)| - |x ^ y|. If x does not link with p, then it links with no y of which D(y) is disjoint from D(x),
and how much they must share follows from the sizes. So differences are joined by their own prefixes,
what p lacks before what p has. What a pair must share follows from its own sizes, so a shared token counts
only if both have enough left from it on, and l tokens are asked for as long as prefixes for l do not reach
what p has: near copies of one text that differ too much seldom meet again.

Everything that decides a link is compared exactly, on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import flagged, free, present, written
from .hashing import mixed, parts, runs, word_hashes

BANDS, ROWS = 6, 2
#: Documents compared with one pivot from which on it is used as such.
LEAST_GROUP = 8
#: The most shared tokens that are asked for of two differences before they are compared.
MOST_ASKED = 4
#: Rows of one pivot that one task may take together, so that a pair is counted once; more are dealt by token.
TOGETHER = 1 << 18
#: Rows of one part from which on they are made fewer before more are read.
LONG_LIST = 200_000
#: Documents that hold a token from which on it is dealt with others, and how many rows (of 72 bytes: 64 MB) such a part may have.
DEALT, MOST_DEALT = 16, (64 << 20) // 72


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a binary column. Fewer words than width are one shingle; none, no shingle."""
    for i, j, data, offsets in parts(texts):
        words, first = word_hashes(data, offsets, lower=True)
        whole = runs(words, np.arange(max(0, len(words) - width + 1)), width)
        short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
        one = dict(zip(short.tolist(), runs(words, first[short], np.diff(first)[short]), strict=True))
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            yield i + k, np.unique(whole[a : b - width + 1]) if b - a >= width else np.array([one[k]] if b > a else [], np.uint64)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _profiles(rows: DataFrame, width: int) -> DataFrame:
    """(doc, n, x, y, bands): size, a 128-bit digest of the set, and min-hash bands."""
    seeds = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y, bands = [], [], [], []
            for _, s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                x.append(np.add.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))))
                y.append(np.add.reduce(mixed(s + np.uint64(0x14057B7EF767814F))))
                least = np.array([mixed(s ^ seed).min() if len(s) else 0 for seed in seeds], np.uint64).reshape(BANDS, ROWS)
                bands += [mixed(least[:, 0] ^ mixed(least[:, 1] ^ seeds[:BANDS]))]
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _signed(x), _signed(y), pa.ListArray.from_arrays(offsets, _signed(np.concatenate(bands) if bands else []))], names=["doc", "n", "x", "y", "bands"])

    return rows.mapInArrow(run, "doc long, n long, x long, y long, bands array<long>")


def _frequent(rows: DataFrame, width: int, most: int, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles (sorted) that most documents hold, about how many, and the smallest of these: at most `most`, whatever the input's size.

    Counts come from all documents, but a task reports only its own most frequent ones; they set the order, the
    costs and which tokens are dealt together, on which no link depends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, lowest, fresh, docs, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], 0

        def add() -> None:
            nonlocal held, counts, lowest, fresh, docs, size
            values, where = np.unique(np.concatenate([held, *fresh]), return_inverse=True)
            n = np.bincount(where, np.concatenate([counts, np.ones(len(where) - len(held), np.int64)])).astype(np.int64)
            low = np.full(len(values), np.iinfo(np.int64).max)
            np.minimum.at(low, where, np.concatenate([lowest, np.repeat(np.array(docs, np.int64), [len(s) for s in fresh])]))
            held, counts, lowest, fresh, docs, size = values, n, low, [], [], 0

        for batch in batches:
            names = batch.column(0).to_pylist()
            for k, s in shingle_sets(batch.column(1), width):
                if names[k] is None:
                    continue
                fresh.append(s)
                docs.append(names[k])
                size += len(s)
                if size > 600_000:
                    add()
                    keep = counts > 1 if len(held) > 600_000 else slice(None)
                    held, counts, lowest = held[keep], counts[keep], lowest[keep]
        add()
        top = np.flatnonzero(counts >= least)
        top = top[np.argsort(-counts[top], kind="stable")[:most // 8]]
        yield pa.RecordBatch.from_arrays([_signed(held[top]), pa.array(counts[top]), pa.array(lowest[top])], names=["token", "n", "low"])

    top = rows.mapInArrow(run, "token long, n long, low long").groupBy("token").agg(F.sum("n").alias("n"), F.min("low").alias("low")).orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n, low = np.asarray(top.column("token")).view(np.uint64), np.asarray(top.column("n")), np.asarray(top.column("low"))
    order = np.argsort(token)
    return token[order], n[order], low[order]


def dealt(tokens: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """By which number a frequent token is dealt to tasks: one of its smallest holder, whose tokens make as many parts as their rows ask for,
    or the token itself where few documents hold it."""
    holder, at = np.unique(low, return_inverse=True)
    many = counts >= DEALT
    parts = 1 + np.bincount(at, np.where(many, counts, 0), len(holder)).astype(np.int64) // MOST_DEALT
    part = mixed(tokens) % parts[at].astype(np.uint64)
    return np.where(many, mixed(mixed(low.astype(np.uint64)) + part), tokens)


def prefix(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """A set's prefix in the common order and its l, the number of shared prefix shingles that it asks for."""
    n = len(s)
    held = np.zeros(n)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        held = np.where(frequent[at] == s, counts[at], 0)
    order = np.lexsort((mixed(s), held))
    needed = (percent * n + 99) // 100
    others = np.cumsum(held[order] + 0.05)
    ladder = [1 << k for k in range(needed.bit_length()) if 1 << k <= needed]
    cost = [(n - needed + x) + n * others[n - needed + x - 1] / x for x in ladder]
    need = ladder[int(np.argmin(cost))]
    return s[order[: n - needed + need]], need


def _prefixes(rows: DataFrame, width: int, percent: int, frequent: np.ndarray, counts: np.ndarray, deal: np.ndarray) -> DataFrame:
    """(doc, n, need, tokens, deals): deals has the number by which each token is dealt."""
    shared = rows.sparkSession.sparkContext.broadcast((frequent, counts, deal))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, deal = shared.value
        for batch in batches:
            at, n, need, tokens = [], [], [], []
            for k, s in shingle_sets(batch.column(1), width):
                if len(s):
                    first, asked = prefix(s, frequent, counts, percent)
                    at.append(k)
                    n.append(len(s))
                    need.append(asked)
                    tokens.append(first)
            edges = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            values = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            parts = values
            if len(frequent):
                place = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                parts = np.where(frequent[place] == values, deal[place], values)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(need, pa.int32()), *(pa.ListArray.from_arrays(pa.array(edges), _signed(x)) for x in (values, parts))], names=["doc", "n", "need", "tokens", "deals"])

    return rows.mapInArrow(run, "doc long, n int, need int, tokens array<long>, deals array<long>")


def _pairs(postings: DataFrame, percent: int) -> DataFrame:
    """From (part, token, cluster, low, high, need, group, at, length), one part's rows together: (a, b, shared, need) for clusters a < b of a token
    whose sizes allow a link and that are not of one group (-1: of none). at: the token's place in the prefix of a cluster's only document, and
    length: how many tokens that has; -1: it has more documents. A part with another number than its token's has all rows of all its tokens."""
    names = ["part", "token", "cluster", "low", "high", "need", "group", "at", "length"]

    def collapsed(tables: list[pa.RecordBatch]) -> list[np.ndarray]:
        """A row for each token and cluster, by part, token and low. Batches that were collapsed before have other types than Spark's, so columns are joined as numbers."""
        part, token, cluster, low, high, need, *rest = (np.concatenate([np.asarray(x.column(c)).astype(np.int64) for x in tables]) for c in names)
        order = np.lexsort((cluster, token))
        token, cluster = token[order], cluster[order]
        starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cluster[1:] != cluster[:-1])))
        first = lambda x: x[order][starts]
        out = [first(part), token[starts], cluster[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts), np.minimum.reduceat(need[order], starts), *map(first, rest)]
        order = np.lexsort((out[3], out[1], out[0]))
        return [x[order] for x in out]

    def met(found: Found, token, cluster, low, high, need, group, place) -> Iterator[pa.RecordBatch]:
        for i, step in steps(token, lambda i, step: 100 * high[i] >= percent * low[i + step]):
            i = i[(group[i] != group[i + step]) | (group[i] < 0)]
            j = i + step
            asked = np.minimum(need[i], need[j])
            longest = asked + (percent * (low[i] + low[j])) // -(100 + percent)  # less what a link shares at least
            on = ((place[i] < 0) | (place[i] < low[i] + longest)) & ((place[j] < 0) | (place[j] < low[j] + longest))
            yield from found.add(cluster[i[on]], cluster[j[on]], asked[on])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        smaller = lambda tables: [pa.RecordBatch.from_arrays([pa.array(c) for c in collapsed(tables)], names=names)]
        for tables in by_token(batches, smaller, "part"):
            part, *columns, length = collapsed(tables)
            alone = part == columns[0]
            yield from met(found, *(x[alone] for x in columns))
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for u, v in zip(edges.tolist(), np.append(edges[1:], len(part)).tolist(), strict=True):
                if alone[u]:
                    continue
                cluster, first, seen = np.unique(columns[1][u:v], return_index=True, return_counts=True)
                unseen = np.where(length[u:v][first] < 0, -1, length[u:v][first] - seen)
                near = Found(left=(cluster, unseen))
                yield from met(near, *(x[u:v] for x in columns))
                yield near.flush()
        yield found.flush()

    return postings.mapInArrow(run, "a long, b long, shared long, need long")


def by_token(batches: Iterator[pa.RecordBatch], smaller=None, key: str = "token") -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by token, cut so that each list has all rows of its tokens. smaller: what to do with a list that one token makes long."""
    held: list[pa.RecordBatch] = []
    most = LONG_LIST
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if cut or (held and np.asarray(held[-1].column(key))[-1] != keys[-1]):
            yield [*held, batch.slice(0, cut)]
            held, most = [batch.slice(cut)], LONG_LIST
        else:
            held.append(batch)
            if smaller and sum(map(len, held)) > most:
                held = smaller(held)
                most = max(LONG_LIST, 2 * sum(map(len, held)))
    if held:
        yield held


def steps(token: np.ndarray, fits) -> Iterator[tuple[np.ndarray, int]]:
    """(at, step): rows at and at + step have one token and fit, for rows sorted by token and then so that what does not fit once never fits again."""
    edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(edge, len(token)))
    end = np.repeat(edge + size, size)
    at, step = np.arange(len(token)), 1
    while len(at := at[at + step < end[at]]):
        at = at[fits(at, step)]
        yield at, step
        step += 1


class Found:
    """Pairs, counted as they come. left: of each cluster (sorted) how many tokens are not among those counted here, or -1; with it, pairs go
    that these cannot bring to their count."""

    def __init__(self, most: int = 500_000, left: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.parts: list[np.ndarray] = []
        self.size, self.most, self.left, self.whole = 0, most, left, True

    def add(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.column_stack([np.minimum(a, b), np.maximum(a, b), need, np.ones(len(a), np.int64)]))
        self.size += len(a)
        if self.size > self.most:
            self.parts = [self.counted()]
            self.size = len(self.parts[0])
            if 2 * self.size > self.most:
                self.whole = False
                yield self.flush()

    def counted(self) -> np.ndarray:
        p = np.concatenate(self.parts) if self.parts else np.zeros((0, 4), np.int64)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        if not len(p):
            return p
        starts = np.flatnonzero(np.append(True, (p[1:, :2] != p[:-1, :2]).any(axis=1)))
        return np.column_stack([p[starts, :2], np.minimum.reduceat(p[:, 2], starts), np.add.reduceat(p[:, 3], starts)])

    def flush(self) -> pa.RecordBatch:
        p = self.counted()
        self.parts, self.size = [], 0
        if self.left and self.whole and len(p):
            names, unseen = self.left
            a, b = (unseen[np.searchsorted(names, p[:, k])] for k in (0, 1))
            p = p[(a < 0) | (b < 0) | (p[:, 3] + np.minimum(a, b) >= p[:, 2])]
        return pa.RecordBatch.from_arrays([pa.array(p[:, k]) for k in (0, 1, 3, 2)], names=["a", "b", "shared", "need"])


def needed(size: np.ndarray, n: np.ndarray, other_size: np.ndarray, other_n: np.ndarray, percent: int) -> np.ndarray:
    """What the differences (n and other_n tokens) of two sets from one set must share for a link."""
    whole = 100 + percent
    return -(((100 - percent) * (size + other_size) - whole * (n + other_n)) // (2 * whole))


def _closer(postings: DataFrame, percent: int) -> DataFrame:
    """From (token, doc, size, group, at, n, need, fresh), one token's rows together: (a, b, shared, need) for documents of different
    groups that this token may help to link. at: the token's place in the difference; n: the difference's size; fresh: how many of it the pivot lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        for tables in by_token(batches):
            table = pa.Table.from_batches(tables)
            token, doc, size, group, at, n, need, fresh = (np.asarray(table.column(c)).astype(np.int64) for c in ("token", "doc", "size", "group", "at", "n", "need", "fresh"))
            order = np.lexsort((size, token))
            token, doc, size, group, at, n, need, fresh = (x[order] for x in (token, doc, size, group, at, n, need, fresh))
            for i, step in steps(token, lambda i, step: 100 * size[i] >= percent * size[i + step]):  # noqa: B023
                j = i + step
                apart = (group[i] != group[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) > 0)
                i, j = i[apart], j[apart]
                share = np.maximum(needed(size[i], n[i], size[j], n[j], percent), np.maximum(need[i], need[j]))
                asked = np.clip(np.minimum(fresh[i] - n[i] + share, fresh[j] - n[j] + share), 1, np.minimum(share, MOST_ASKED))
                on = (at[i] < n[i] - share + asked) & (at[j] < n[j] - share + asked)
                yield from found.add(doc[i[on]], doc[j[on]], asked[on])
        yield found.flush()

    return postings.mapInArrow(run, "a long, b long, shared long, need long")


def difference(head: np.ndarray, s: np.ndarray, both: np.ndarray, linked: bool, percent: int) -> tuple[np.ndarray, int, int, int]:
    """The prefix of the symmetric difference by which s meets others of its pivot, the difference's size, how much of it any link
    takes, and how much of it the head lacks; both: which of s the head has.

    Of a linked set, a link to an unlinked one takes more than (1 - c) / 2 of its difference, c = (1 - t) / (1 + t);
    of an unlinked set it takes at least |D| - |s| (1 - t) / t.
    """
    new = s[~both]
    gone = np.setdiff1d(head, s, assume_unique=True)
    n = len(new) + len(gone)
    need = percent * n // (100 + percent) + 1 if linked else max(1, n - len(s) * (100 - percent) // percent)
    ordered = np.concatenate([new[np.argsort(mixed(new))], gone[np.argsort(mixed(gone))]])
    return ordered[: max(0, n - need + 1, min(len(new), n - need + MOST_ASKED))], n, need, len(new)


def _compared(rows: DataFrame, pairs: DataFrame, width: int, percent: int, differ: bool = False, chunk: int = 400) -> DataFrame:
    """pairs(a, b) with linked, compared on the sets of both texts, and with differ what difference() says of b from a, where that
    is the smaller part. Each a's partners are split into chunks. Without differ only linked pairs are returned."""
    pairs = written(pairs, "pairs")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    members = pairs.join(chunks, "a").select(F.col("b").alias("d"), F.col("a").alias("group"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"))
    heads = chunks.select(F.col("a").alias("d"), F.col("a").alias("group"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    needed = members.unionByName(heads)
    found = present(rows.select("doc", "text"), needed.select(F.col("d").alias("doc")), "doc").join(needed, F.col("doc") == F.col("d")).select("group", "chunk", "role", "doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            group, chunks, role, doc = (np.asarray(batch.column(c)) for c in ("group", "chunk", "role", "doc"))
            a, b, links, parts, sizes = [], [], [], [], []
            for k, s in shingle_sets(batch.column("text"), width):
                if role[k] == 0:
                    at, head = (group[k], chunks[k]), s
                elif at == (group[k], chunks[k]) and len(s) and len(head) and doc[k] != group[k]:
                    hit = head[np.minimum(np.searchsorted(head, s), len(head) - 1)] == s
                    both = int(np.count_nonzero(hit))
                    linked = 100 * both >= percent * (len(s) + len(head) - both)
                    if linked or differ:
                        a.append(group[k])
                        b.append(doc[k])
                        links.append(linked)
                        near = differ and len(s) + len(head) - 2 * both < len(s)
                        found, *more = difference(head, s, hit, linked, percent) if near else (None, 0, 0, 0)
                        parts.append(found.view(np.int64).tolist() if near else None)
                        sizes.append(more)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.bool_()), pa.array(parts, pa.list_(pa.int64())), *(pa.array([x[k] for x in sizes], pa.int32()) for k in range(3))], names=["a", "b", "linked", "differs", "total", "need", "fresh"])

    return found.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "role").mapInArrow(run, "a long, b long, linked boolean, differs array<long>, total int, need int, fresh int")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, frequent: int = 200_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_shingles and component_id, the smallest key that links reach, itself included.

    A row's set holds the distinct runs of width words of its text, A-Z as a-z; fewer words are one shingle,
    and null, empty or blank texts have none and link with nothing. Rows link if 100 * |intersection| >=
    percent * |union|. keys are integers; rows with one key are one node; a null key links with nothing and
    has a null component. frequent bounds the table of frequent shingles. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    profiles = written(_profiles(rows, width), "profiles")
    sets = profiles.filter("n > 0 and doc is not null").groupBy("n", "x", "y").agg(F.min("doc").alias("rep"), F.min("bands").alias("bands"))
    sets = written(sets, "sets")
    # First round: buckets of min-hash bands, each document with the one of its bucket that stands in the fullest buckets.
    buckets = sets.select("rep", F.posexplode("bands").alias("band", "value"))
    sizes = buckets.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(buckets.join(sizes, ["band", "value"]), "buckets")
    typical = shared.join(shared.groupBy("rep").agg(F.sum("size").alias("score")), "rep")
    first = typical.groupBy("band", "value").agg(F.max(F.struct("score", (-F.col("rep")).alias("m"))).alias("x")).select("band", "value", (-F.col("x.m")).alias("a"))
    star = shared.join(first, ["band", "value"]).filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    near = written(_compared(rows, star, width, percent, differ=True), "links")
    clusters = written(components(near.filter("linked")), "clusters")
    groups = near.filter("differs is not null").groupBy("a").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= LEAST_GROUP)
    choice = near.filter("differs is not null").join(groups, "a").select("b", "a", "size", "differs", "total", "need", "fresh")
    choice = choice.unionByName(groups.select(F.col("a").alias("b"), "a", "size", F.array().cast("array<long>").alias("differs"), *(F.lit(0).alias(c) for c in ("total", "need", "fresh"))))
    best = choice.groupBy("b").agg(F.max(F.struct("size", (-F.col("a")).alias("m"), "differs", "total", "need", "fresh")).alias("x"))
    pivots = written(best.select(F.col("b").alias("doc"), (-F.col("x.m")).alias("pivot"), "x.differs", "x.total", "x.need", "x.fresh"), "pivots")
    members = sets.select("rep", "n").join(clusters, F.col("rep") == F.col("id"), "left").join(pivots.select("doc", "pivot"), F.col("rep") == F.col("doc"), "left")
    members = written(members.select("rep", "n", F.coalesce("component", "rep").alias("cluster"), F.coalesce("pivot", F.lit(-1)).alias("pivot")), "members")
    grouped = members.groupBy("cluster").agg(F.min("pivot").alias("low"), F.max("pivot").alias("high"), F.count(F.lit(1)).alias("size")).select("cluster", (F.col("size") == 1).alias("alone"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1).alias("group"))
    # Second round: the prefix join between clusters.
    tokens, counts, low = _frequent(rows, width, frequent)
    reps = members.select("rep", "cluster").join(grouped, "cluster")
    prefixes = _prefixes(rows, width, percent, tokens, counts, dealt(tokens, counts, low)).join(reps, F.col("doc") == F.col("rep"))
    only = lambda c: F.when(F.col("alone"), c).otherwise(-1)
    wide = prefixes.select(F.posexplode(F.arrays_zip("deals", "tokens")).alias("at", "x"), "cluster", F.col("n").alias("low"), F.col("n").alias("high"), "need", "group", "alone", F.size("tokens").alias("length"))
    wide = wide.select(F.col("x.deals").alias("part"), F.col("x.tokens").alias("token"), "cluster", "low", "high", "need", "group", only(F.col("at")).alias("at"), only(F.col("length")).alias("length"))
    counted = _pairs(wide.repartition("part").sortWithinPartitions("part"), percent)
    pairs = written(counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b"), "cluster-pairs")
    kinds = members.groupBy("cluster", "pivot").agg(F.count(F.lit(1)).alias("size"))
    for c in ("a", "b"):
        pairs = pairs.join(kinds.select(F.col("cluster").alias(c), F.col("pivot").alias(f"{c}_pivot"), F.col("size").alias(f"{c}_size")), c)
    pairs = pairs.filter("a_pivot <> b_pivot or a_pivot = -1")
    for c in ("a", "b"):
        pairs = pairs.join(members.select(F.col("cluster").alias(c), F.col("pivot").alias(f"{c}_pivot"), F.col("rep").alias(f"{c}_doc"), F.col("n").alias(f"{c}_n")), [c, f"{c}_pivot"])
    swap = F.col("a_size") > F.col("b_size")  # the text with more partners is sent once to each chunk of them
    fits = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    pairs = pairs.filter(fits).select(F.when(swap, F.col("b_doc")).otherwise(F.col("a_doc")).alias("a"), F.when(swap, F.col("a_doc")).otherwise(F.col("b_doc")).alias("b"))
    # Third round: documents of one pivot, by their differences from it.
    own = pivots.join(members.drop("pivot"), F.col("doc") == F.col("rep")).select(F.posexplode("differs").alias("at", "t"), "pivot", "doc", F.col("n").alias("size"), F.col("cluster").alias("group"), F.col("total").alias("n"), "need", "fresh")
    rows_of = pivots.groupBy("pivot").agg(F.sum(F.size("differs")).alias("rows"))
    own = own.withColumn("token", F.xxhash64("pivot", "t")).join(rows_of, "pivot")
    own = own.withColumn("part", F.when(F.col("rows") <= TOGETHER, F.xxhash64("pivot")).otherwise(F.col("token"))).drop("t", "pivot", "rows")
    met = _closer(own.repartition("part").sortWithinPartitions("token").drop("part"), percent)
    closer = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")
    more = _compared(rows, pairs.unionByName(closer).distinct(), width, percent)
    linked = components(near.filter("linked").select("a", "b").unionByName(more.select("a", "b")))
    final = sets.join(linked, F.col("rep") == F.col("id"), "left").select(F.col("n").alias("_n"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.coalesce("component", "rep").alias("component"))
    out = profiles.join(final, (F.col("n") == F.col("_n")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & F.col("doc").isNotNull(), "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows that link to one with a smaller key; classes: as jaccard_components returns them.

    Rows with one key are one document and stay together; rows with a null key stay.
    """
    gone = written(classes.filter(F.col("component_id") < F.col(key)).select(key).distinct(), "gone")
    maybe = free(docs, "maybe")
    rows = flagged(docs, gone, key, maybe)
    return rows.filter(~F.col(maybe)).drop(maybe).unionByName(rows.filter(F.col(maybe)).drop(maybe).join(gone, key, "left_anti"))
