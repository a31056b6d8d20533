"""Audio columns: samples in WAV form, polyphase resampling, log-mel frames and energy segments."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class AudioOptions:
    """rate: samples a second as stored; up/down: the resampling ratio; taps: filter taps for each phase;
    frame, hop: samples of a frame and between frames, after resampling; mels: filterbank bands;
    high, low: standard deviations above the mean log energy at which a segment begins, and ends;
    shape: frames in each tensor."""

    rate: int = 16000
    up: int = 1
    down: int = 2
    taps: int = 16
    frame: int = 256
    hop: int = 128
    mels: int = 24
    high: float = 0.5
    low: float = -0.25
    shape: int = 32


def wav(samples: bytes, rate: int) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF container; odd data gets the pad byte the format asks for."""
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + samples + b"\0" * (n % 2)


def wav_samples(stored: bytes) -> bytes:
    """The data chunk of such a file, found by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at = 12
    while at + 8 <= len(stored):
        name, n = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def payload(text: str | None, block: int = 576, fill: int = 255) -> tuple[int, bytes]:
    """Bytes of the text, and its UTF-8 filled up to a positive multiple of block."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + bytes([fill]) * (block - len(data) % block if len(data) % block or not data else 0)


@functools.lru_cache(maxsize=8)
def _resampler(o: AudioOptions) -> np.ndarray:
    """The windowed-sinc low-pass, split into `up` phases of `taps` coefficients."""
    n = o.taps * o.up
    t = (np.arange(n) - (n - 1) / 2) / max(o.up, o.down)
    h = np.sinc(t) * np.hanning(n + 2)[1:-1]
    h *= o.up / h.sum()
    return np.ascontiguousarray(h.reshape(o.taps, o.up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, o: AudioOptions) -> np.ndarray:
    """Output k is phase (k * down) % up of the filter over the input around k * down / up."""
    phases = _resampler(o)
    padded = np.concatenate([np.zeros(o.taps // 2, np.float32), x, np.zeros(o.taps, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, o.taps)
    n = (len(x) * o.up + o.down - 1) // o.down
    out = np.empty(n, np.float32)
    for first in range(min(o.up, n)):  # outputs first, first + up, ... all use one phase and start `down` inputs apart
        rows = views[first * o.down // o.up :: o.down][: len(range(first, n, o.up))]
        out[first :: o.up] = rows @ phases[first * o.down % o.up]
    return out


@functools.lru_cache(maxsize=8)
def _filterbank(o: AudioOptions) -> tuple[np.ndarray, np.ndarray]:
    top = o.rate * o.up / o.down / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), o.mels + 2) / 2595) - 1)
    f = np.linspace(0, top, o.frame // 2 + 1)
    rise = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.hanning(o.frame).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def log_mel(x: np.ndarray, o: AudioOptions) -> np.ndarray:
    """Frames x mels: log of the filterbank's energies, in hundredths, as int16 so that equal audio gives equal values.

    Silence fills the last frame, so that every sample is in one.
    """
    missing = o.frame - len(x) if len(x) < o.frame else -(len(x) - o.frame) % o.hop
    x = np.concatenate([x, np.zeros(missing, np.float32)])
    window, bank = _filterbank(o)
    frames = np.lib.stride_tricks.sliding_window_view(x, o.frame)[:: o.hop]
    out = []
    for i in range(0, len(frames), 4096):  # bounded memory for very long audio
        power = np.abs(np.fft.rfft(frames[i : i + 4096] * window, axis=1)) ** 2
        out.append(np.rint(100 * np.log(power.astype(np.float32) @ bank + 1e-6)).astype(np.int16))
    return np.concatenate(out)


def segments(mel: np.ndarray, o: AudioOptions) -> list[tuple[int, int]]:
    """Ranges of frames: one begins above the high threshold and lasts until the energy is below the low one."""
    energy = mel.sum(axis=1, dtype=np.int64)
    mean, spread = float(energy.mean()), float(energy.std())
    if spread == 0:
        return [(0, len(energy))]
    loud, quiet = energy > mean + o.high * spread, energy < mean + o.low * spread
    mark = np.where(loud, 1, np.where(quiet, -1, 0))
    where = np.flatnonzero(mark)
    kinds = mark[where]
    turns = where[np.concatenate([[True], kinds[1:] != kinds[:-1]])] if len(where) else where
    found, begin = [], None
    for i in turns.tolist():
        if mark[i] > 0:
            begin = i
        elif begin is not None:
            found.append((begin, i))
            begin = None
    if begin is not None:
        found.append((begin, len(energy)))
    return found


def features(stored: bytes, o: AudioOptions) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """Samples as read back, log-mel frames, and the segments, in frames."""
    samples = wav_samples(stored)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, o), o)
    return samples, mel, segments(mel, o)


def tensors(mel: np.ndarray, spans: list[tuple[int, int]], o: AudioOptions) -> tuple[pa.Array, list[float], list[float], list[float]]:
    """The frames as a fixed-shape tensor array (zeros after the end), with each tensor's start and end in milliseconds and the share of its frames inside segments."""
    ms = 1000 * o.down / (o.rate * o.up)
    inside = np.zeros(len(mel), bool)
    for a, b in spans:
        inside[a:b] = True
    starts = range(0, len(mel), o.shape)
    ends = [min(i + o.shape, len(mel)) for i in starts]
    block = np.zeros((len(starts) * o.shape, o.mels), np.int16)
    block[: len(mel)] = mel
    made = pa.FixedShapeTensorArray.from_numpy_ndarray(block.reshape(len(starts), o.shape, o.mels))
    return made, [i * o.hop * ms for i in starts], [((e - 1) * o.hop + o.frame) * ms for e in ends], [float(inside[i:e].mean()) for i, e in zip(starts, ends, strict=True)]


def audio_tensors(docs: DataFrame, options: AudioOptions | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs one row for each tensor: key, tensor_no, start_ms, end_ms, voiced (the share of its
    frames inside segments) and tensor, the (shape x mels) log-mel values in hundredths, row by row, zeros after the end.

    Texts are the samples as in audio_digests. All tensors have the same shape, so the column is a
    fixed-shape tensor of `shape * mels` values; `as_fixed_shape` gives Arrow's type for it.
    """
    o = options or AudioOptions()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, value in zip(part.column(1), part.column(0), strict=True):
                _, mel, spans = features(wav(payload(value.as_py())[1], o.rate), o)
                made, begin, end, voiced = tensors(mel, spans, o)
                offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * (o.shape * o.mels))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()] * len(made), part.column(1).type), pa.array(range(len(made)), pa.int32()), pa.array(begin), pa.array(end), pa.array(voiced), pa.ListArray.from_arrays(offsets, made.storage.flatten())],
                    names=[key, "tensor_no", "start_ms", "end_ms", "voiced", "tensor"],
                )

    return docs.select(docs[text].alias("_text"), key).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, tensor_no int, start_ms double, end_ms double, voiced double, tensor array<smallint>")


def as_fixed_shape(tensors: pa.ChunkedArray | pa.Array, options: AudioOptions | None = None) -> pa.Array:
    """The column `tensor` as Arrow's fixed-shape tensor array."""
    o = options or AudioOptions()
    flat = tensors.combine_chunks() if isinstance(tensors, pa.ChunkedArray) else tensors
    kind = pa.fixed_shape_tensor(pa.int16(), (o.shape, o.mels))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.int16()), o.shape * o.mels))


def audio_digests(docs: DataFrame, options: AudioOptions | None = None, block: int = 576, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The text's UTF-8 (null: none), filled with 255 up to a positive multiple of block, is stored as
    unsigned 8-bit samples in WAV form; what is returned comes from the samples read back from there.
    feature: frames, tensors, segments, the share of frames in segments, and a digest of the fixed-shape
    tensors, their time spans and the segments. Equal texts have equal values, whatever stands beside them; rows stay separate; an empty
    table gives an empty result; further columns are left out. One narrow pass.
    """
    o = options or AudioOptions()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for value in part.column(0):
                n, data = payload(value.as_py(), block)
                stored = wav(data, o.rate)
                samples, mel, spans = features(stored, o)
                made, begin, end, _ = tensors(mel, spans, o)
                digest = sha256(made.storage.flatten().to_numpy().tobytes() + repr((spans, begin, end)).encode()).hexdigest()[:32]
                voiced = sum(b - a for a, b in spans) / len(mel)
                rows.append((n, len(samples), sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), sha256(stored).hexdigest(), f"frames={len(mel)};tensors={len(made)};segments={len(spans)};voiced={voiced:.4f};digest={digest}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, *NAMES])

    return docs.select(docs[text].alias("_text"), key).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
