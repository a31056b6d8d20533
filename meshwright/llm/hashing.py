"""64-bit hashes of words and of runs of words, for many texts at a time.

A hash is a polynomial modulo 2^64 in a fixed odd number, taken as a difference of prefix sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASES = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xC2B2AE3D27D4EB4F | 1}
_powers: dict[str, np.ndarray] = {}
_inverse: dict[str, np.ndarray] = {}


def _table(kept: dict[str, np.ndarray], kind: str, base: int, n: int) -> np.ndarray:
    if kind not in kept or len(kept[kind]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        kept[kind] = np.cumprod(factors, dtype=np.uint64)
    return kept[kind][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, first: np.ndarray, length: np.ndarray | int, kind: str = "word") -> np.ndarray:
    """Hash of values[f : f + length] for each f in first."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _table(_powers, kind, _BASES[kind], n), out=sums[1:], dtype=np.uint64)
    inverse = _table(_inverse, kind, pow(_BASES[kind], -1, 1 << 64), n + 1)
    return mixed((sums[first + length] - sums[first]) * inverse[first])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and where each text's words begin, and end, among them.

    data: UTF-8 bytes; offsets: where texts begin, and the end. lower: A-Z count as a-z.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] |= inside[borders]
    ends[borders - 1] |= inside[borders - 1]
    first = np.flatnonzero(begins)
    last = np.flatnonzero(ends) + 1
    h = runs(data.astype(np.uint64) + np.uint64(1), first, last - first, "byte") + (last - first).astype(np.uint64)
    return mixed(h), np.searchsorted(first, offsets)


def parts(texts: pa.Array, most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a binary column into stretches of about `most` bytes: first row, end row, bytes, offsets."""
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts.slice(0), texts.slice(0, 0)])
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most)))
        j = min(j, len(texts))
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) of every width values in a row."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out
