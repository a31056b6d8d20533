"""Byte-level BPE: encoding with a priority queue of merges over a linked symbol list, and decoding."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """Ids of a word, with what stands before it, by the word."""

    def __init__(self, coder: BytePairs, before: str) -> None:
        self.coder, self.before = coder, before

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.coder._chunks(self.before + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class BytePairs:
    """A byte-level BPE vocabulary from the JSON file of the tokenizers library.

    max_cached bounds the encodings of chunks that are kept; when full they are dropped and begun anew.
    """

    def __init__(self, path: str, pattern: str, max_cached: int = 120_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: Pair of token ids -> (rank, id of the merged token).
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            self.pieces[i] = token.encode()
        self.names = [str(i) for i in range(size)]
        self.special = special
        self.chunks = regex.compile(pattern).findall
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.max_cached = max_cached
        self.cached: dict[str, tuple[int, ...]] = {}
        self.spaced, self.bare = _Words(self, " "), _Words(self, "")
        white = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
        self.breaks = regex.compile(f"[{white}]{{2,}}|[{white.replace(' ', '')}]").finditer

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Token ids of one chunk."""
        first, merges = self.first, self.merges
        sym = [first[b] for b in data]
        n = len(sym)
        if n < 2:
            return tuple(sym)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m[0], i, sym[i], sym[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            _, i, a, b, new = pop(queue)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: one of the two has merged meanwhile
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, sym[k])):
                    push(queue, (m[0], i, new, sym[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                push(queue, (m[0], h, sym[h], new, m[1]))
        return tuple(x for x in sym if x >= 0)

    def _chunks(self, text: str) -> tuple[int, ...]:
        """Ids of a short stretch of text: of each chunk that the pattern finds, one after the other."""
        out: tuple[int, ...] = ()
        for chunk in self.chunks(text):
            ids = self.cached.get(chunk)
            if ids is None:
                ids = self.merge(chunk.encode("utf-8", "replace"))
                if len(chunk) <= 64:
                    if len(self.cached) >= self.max_cached:
                        self.cached.clear()
                    self.cached[chunk] = ids
            out += ids
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        """A chunk never goes on behind a single space that stands between two other characters, so words are
        looked up whole; only longer or other white space is told apart as the pattern does it: its last
        character belongs to what follows if it is a space, and is a chunk of its own if not."""
        bare, spaced = self.bare, self.spaced
        lines = [line.split() for line in text.split("\n")]
        if "\n".join(map(" ".join, lines)) == text and all(lines):  # single spaces and line ends only
            end = bare["\n"]
            for i, (first, *rest) in enumerate(lines):
                if i:
                    out += end
                out += bare[first]
                for ids in map(spaced.__getitem__, rest):
                    out += ids
        else:
            self._mixed(text, out)
        if len(spaced) + len(bare) > self.max_cached:
            spaced.clear()
            bare.clear()

    def _mixed(self, text: str, out: list[int]) -> None:
        at, lead = 0, False
        for m in self.breaks(text):
            if m.start() > at or lead:
                lead = self._words(text[at : m.start()], lead, out)
            white, at = m.group(), m.end()
            if at == len(text):
                out += self._chunks(white)
            else:
                lead = white[-1] == " "
                if len(white) > 1:
                    out += self._chunks(white[:-1])
                if not lead:
                    out += self._chunks(white[-1])
        if at < len(text):
            self._words(text[at:], lead, out)

    def _words(self, text: str, lead: bool, out: list[int]) -> bool:
        first, *rest = text.split(" ")
        if lead:
            out += self.spaced[first]
        elif first:
            out += self._chunks(first)
        for ids in map(self.spaced.__getitem__, rest):
            out += ids
        return False

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them: its added tokens are found in the text first, nothing is added."""
        out: list[int] = []
        if self.specials is None or not any(s in text for s in self.special):
            self._plain(text, out)
            return out
        for part in self.specials.split(text):
            if (i := self.special.get(part)) is not None:
                out.append(i)
            else:
                self._plain(part, out)
        return out

    def forget(self) -> None:
        for kept in (self.cached, self.spaced, self.bare):
            kept.clear()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's byte strings one after the other; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    import public_tokenizers

    return BytePairs(path, public_tokenizers.PATTERN)


def bpe_round_trip(docs: DataFrame, model: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns per row: key, the columns in keep, n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded text), and with with_ids also ids and decoded. Null and
    empty texts have no ids; equal rows stay separate; an empty table gives an empty result; further
    columns are left out. model: a name at public_tokenizers.path, or a full path. One narrow pass.
    """
    more = ["ids", "decoded"] if with_ids else []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = byte_pairs(model if "/" in model else public_tokenizers.path(model))
        names = coder.names.__getitem__
        for part in parts:
            n, hashes, back, all_ids, texts = [], [], [], [], []
            for value in part.column(0):
                ids = coder.encode(value.as_py() or "")
                decoded = coder.decode(ids)
                n.append(len(ids))
                hashes.append(sha256(",".join(map(names, ids)).encode()).hexdigest())
                back.append(sha256(decoded.encode("utf-8", "replace")).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    texts.append(decoded)
            made = [pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                made += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*part.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256", *more])
        coder.forget()  # the worker may go on with other work

    columns = [key, *(c for c in keep if c != key)]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    kinds += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + (["ids array<int>", "decoded string"] if with_ids else [])
    return docs.select(docs[text].alias("_text"), *columns).mapInArrow(run, ", ".join(kinds))
