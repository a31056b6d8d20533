"""Token counts by a finite-state transducer compiled from a sentencepiece BPE model.

The model merges adjacent symbols, best score first and leftmost among equals, until nothing
merges. Whether such an encoding puts a token `b` after a token `a` depends on `a` and `b` alone:
the encoding of a prefix ends in the one token that is compatible with the last token of what
stands before it. So a left-to-right automaton can keep, for each suffix of the read text that
begins some piece, the token that ends where this suffix starts and how many tokens there are up
to it, relative to now. Those finitely many configurations are the states; a transition carries
the change of the token count, which may be negative. States are compiled when first reached
(a lazy determinization with a bounded table that is emptied when full).

A batch of texts is laid end to end and cut into equal chunks that all advance in step. A chunk's
state map is constant from its first synchronising symbol on, so chunks run from there at once;
the maps are then composed in order: each chunk's head runs from its predecessor's exit state.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
RESET, OOV = 0, 1  # columns: start of a text; OOV + k: a character outside the vocabulary, of k + 1 bytes


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The encoding by definition, for short strings: agenda of merges over linked symbols."""
    n, sym = len(text), list(text)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (s := scores.get(p := sym[i] + sym[j])) is not None:
            heapq.heappush(heap, (-s, i, j, p))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, p = heapq.heappop(heap)
        if right[i] != j or sym[i] + sym[j] != p or not sym[j]:
            continue  # stale
        sym[i], sym[j] = p, ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        right[j] = -2
        offer(left[i], i)
        offer(i, right[i])
    return [s for s in sym if s]


class Transducer:
    """Counts tokens. max_entries bounds the transition table (4 bytes each)."""

    def __init__(self, pieces: list[tuple[str, float]], max_entries: int = 24_000_000, lanes: int = 4096) -> None:
        self.scores = dict(pieces)
        self.max_entries, self.lanes = max_entries, lanes
        self.alphabet = {c for p in self.scores for c in p}
        if missing := [c for c in self.alphabet if c not in self.scores]:
            raise ValueError(f"characters that are no pieces: {missing[:5]}")
        self.child: list[dict[str, int]] = [{}]
        self.path = [""]
        for p in self.scores:
            at = 0
            for c in p:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.path.append(self.path[at] + c)
                at = self.child[at][c]
        self.below: list[list[str]] = [[] for _ in self.path]
        for p in self.scores:
            at = 0
            for c in p:
                at = self.child[at][c]
                self.below[at].append(p)
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.useful: dict[tuple[str, int], bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[bool, list, list]] = {}
        self.column = np.full(0x110000, -1, np.int32)
        self.symbol: list[str | int] = [-1, 1, 2, 3, 4]
        self.width = 96
        self._empty()

    def _empty(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full(max(64, min(8192, self.max_entries // self.width)) * self.width, -1, np.int32)
        self._intern(self.START)

    #: For each suffix of the text that begins a piece, longest first: (its node, the token before it, tokens up to there relative to now)
    START = ((0, "", 0),)

    def _intern(self, state: tuple) -> int:
        if (i := self.ids.get(state)) is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            if len(self.states) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        return i

    def _edges(self, token: str) -> tuple[bool, list, list]:
        """Whether merges run in order of score inside the token and, from the left and the right edge,
        its parts as they stand at the edge one after the other: (text, score, score of the merge that ends it)."""
        if (found := self.edges.get(token)) is None:
            parts = [*token]
            born = [float("inf")] * len(parts)
            left, right, ordered, last = [], [], True, float("inf")
            while len(parts) > 1:
                options = [(-self.scores[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores]
                if not options:
                    ordered = False
                    break
                score, i = min(options)
                score = -score
                ordered, last = ordered and score <= last, score
                if i == 0:
                    left.append((parts[0], born[0], score))
                if i == len(parts) - 2:
                    right.append((parts[-1], born[-1], score))
                parts[i : i + 2], born[i : i + 2] = [parts[i] + parts[i + 1]], [score]
            whole = (token, born[0], float("-inf"))
            found = self.edges[token] = (ordered and token.strip(SPACE) != "" and len(parts) == 1, [*left, whole], [*right, whole])
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is a, b."""
        if (found := self.fits.get((a, b))) is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            plain, starts, _ = self._edges(b)
            if plain and not a:
                found = True
            elif plain and (of_a := self._edges(a))[0]:  # a merge across the border needs two parts at the edges at one time
                get, found = self.scores.get, True
                for x, x_from, x_to in of_a[2]:
                    for y, y_from, y_to in starts:
                        if min(x_from, y_from) > max(x_to, y_to) and (s := get(x + y)) is not None and s > x_to and s >= y_to:
                            found = False
                            break
            else:
                found = merge(a + b, self.scores) == ([a, b] if a else [b])
            self.fits[a, b] = found
        return found

    def matters(self, token: str, node: int) -> bool:
        """Whether some piece that begins with node's path can follow token; tried only where few begin so."""
        if len(self.below[node]) > 12:
            return True
        if (found := self.useful.get((token, node))) is None:
            if len(self.useful) > 300_000:
                self.useful.clear()
            found = self.useful[token, node] = any(self.compatible(token, t) for t in self.below[node])
        return found

    def step(self, state: tuple, symbol: str | int) -> tuple[tuple, int]:
        """The next state and the change of the count."""
        if not isinstance(symbol, str):
            return self.START, max(symbol, 0)
        token, grown = None, []
        for node, before, n in state:
            if (x := self.child[node].get(symbol)) is not None:
                if token is None and (t := self.path[x]) in self.scores and self.compatible(before, t):
                    token, change = t, n + 1
                grown.append((x, before, n))
        assert token is not None, (state, symbol)
        if (end := state[-1][1]) and end[-1] + symbol not in self.pairs:  # no piece spans this place: what precedes does not matter
            grown = [(grown[-1][0], "", grown[-1][2])]
        return (*((x, t, n - change) for x, t, n in grown if self.matters(t, x)), (0, token, 0)), change

    def _compile(self, keys: np.ndarray) -> None:
        for key in keys.tolist():
            i, c = divmod(key, self.width)
            nxt, change = self.step(self.states[i], self.symbol[c])
            self.table[key] = self._intern(nxt) * 64 + change + 32

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        cols = self.column[codes]
        if (new := cols < 0).any():
            for code in np.unique(codes[new]).tolist():
                if (c := chr(code)) in self.alphabet:
                    self.column[code] = len(self.symbol)
                    self.symbol.append(c)
                else:
                    self.column[code] = OOV + len(c.encode("utf-8", "surrogatepass")) - 1
            if len(self.symbol) > self.width:
                self.width = (len(self.symbol) // 32 + 2) * 32
                self._empty()
            cols = self.column[codes]
        return cols

    def _run(self, cols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Advances lanes from begin to end (positions in cols), writing changes to out; returns exit states."""
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that active lanes stay a prefix
        at, left, st = begin[order].copy(), (end - begin)[order], state[order].astype(np.int64)
        n = int((left > 0).sum())
        for k in range(int(left[0]) if len(left) else 0):
            while n and left[n - 1] <= k:
                n -= 1
            here = at[:n] + k
            key = st[:n] * self.width + cols[here]
            v = self.table[key]
            while v.min() < 0:
                if (len(self.states) + n) * self.width > self.max_entries:  # full: keep only the states in use
                    held, where = np.unique(st, return_inverse=True)
                    kept = [self.states[i] for i in held.tolist()]
                    self._empty()
                    st = np.array([self._intern(x) for x in kept], np.int64)[where]
                    key = st[:n] * self.width + cols[here]
                    v = self.table[key]
                self._compile(np.unique(key[v < 0]))
                v = self.table[key]
            st[:n] = v >> 6
            out[here] = (v & 63) - 32
        result = np.empty_like(st)
        result[order] = st
        return result

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        parts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        lens = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        codes = np.frombuffer("\0".join(["", *parts]).encode("utf-32-le", "surrogatepass"), np.uint32)[: int(lens.sum()) + len(parts)]
        cols = self._columns(codes)
        cols = cols.copy()
        cols[starts] = RESET
        n = len(cols)
        lanes = max(1, min(self.lanes, n // 256))
        cut = np.linspace(0, n, lanes + 1).astype(np.int64)
        begin, end = cut[:-1], cut[1:]
        sync = cols < OOV + 4
        space = self.column[ord(SPACE)]
        sync[1:] |= (cols[1:] == space) & (cols[:-1] != space)
        where = np.flatnonzero(sync)
        k = np.searchsorted(where, begin)
        first = np.where(k < len(where), where[np.minimum(k, len(where) - 1)], n)
        first = np.minimum(first, end)  # == end: the chunk has no synchronising symbol
        out = np.zeros(n, np.int8)
        constant = first < end
        leave = np.zeros(lanes, np.int64)
        held = self._hold(leave)
        leave = self._run(cols, first, end, leave, out)
        held = self._hold(leave)
        # Scan: heads run from the exit of the chunk before, as soon as that is known.
        known, done = constant.copy(), first == begin
        while not done.all():
            ready = np.flatnonzero(~done & np.concatenate([[True], known[:-1]]))
            entry = self._release([held[i - 1] if i else self.START for i in ready.tolist()])
            exits = self._hold(self._run(cols, begin[ready], first[ready], entry, out))
            for i, x in zip(ready.tolist(), exits, strict=True):
                if not constant[i]:
                    held[i], known[i] = x, True
            done[ready] = True
        sums = np.concatenate([[0], np.cumsum(out, dtype=np.int64)])
        return sums[np.concatenate([starts[1:], [n]])] - sums[starts]

    def _hold(self, ids: np.ndarray) -> list[tuple]:
        return [self.states[i] for i in ids.tolist()]

    def _release(self, states: list[tuple]) -> np.ndarray:
        return np.array([self._intern(s) for s in states], np.int64)


@functools.lru_cache(maxsize=2)
def transducer(model_path: str) -> Transducer:
    """One for each worker and model; compiled states stay for its next tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(sp.get_piece_size())
    return Transducer([(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))])


def batches(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters each."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 2
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    model: a sentencepiece BPE model, by its name at public_tokenizers.path or by a full path.
    Null and empty texts have no bytes and no tokens. Rows with the same key stay separate rows;
    other columns are left out; an empty table gives an empty result. One narrow pass, no shuffle.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        machine = transducer(model if "/" in model else public_tokenizers.path(model))
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts = [machine.count(texts[a:b]) for a, b in batches(texts)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
