"""Audio features of media columns: polyphase resampling, log-mel filterbanks, hysteresis segmentation.

Media is 8-bit mono PCM in a RIFF/WAVE container, stored as a binary column.
Samples are centred, resampled by 2/3 with a windowed-sinc polyphase bank,
cut into frames of 256 with a hop of 128, and turned into 32 log-mel levels in
half-decibel steps (one byte each). Frames are active from an energy of the
median plus `HIGH_DB` until one below the median plus `LOW_DB`. Levels are
stored in the shared folder as fixed-shape Arrow tensors (64 frames x 32
bands, the last padded with zeros), each with the time span it covers, and
`feature` is derived from what is read back.

A document's features are computed from its samples alone with the same array
shapes wherever it stands, so equal media have equal features.

Defined results: null and empty texts are one block of 192 spaces; silence has
no active segments; rows are independent, so ties, repeats and empty tables
need no rule; only (doc_id, text) or (doc_id, media) are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gavel.llm.store import stored

RATE = 12_000
UP, DOWN = 2, 3
FRAME, HOP, BANDS = 256, 128, 32
TENSOR_FRAMES = 64
HIGH_DB, LOW_DB = 1.0, -1.0
#: Payloads are filled with bytes 32 to a positive multiple of this.
BLOCK = 192


def wav(samples: bytes) -> bytes:
    """8-bit mono PCM; an odd payload gets the pad byte that RIFF asks for."""
    pad = b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad


def wav_samples(media: bytes) -> bytes:
    """The data chunk of a RIFF/WAVE string."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _phases(taps: int = 12) -> np.ndarray:
    """The low-pass filter of the resampler, one row for each phase."""
    n = np.arange(UP * taps) - (UP * taps - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(UP * taps)
    rows = np.stack([h[p::UP][::-1] for p in range(UP)])
    return rows / rows.sum(1, keepdims=True)


def _mel() -> np.ndarray:
    """Triangular filters (bands x FFT bins), evenly spaced on the mel scale to half the new rate."""
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), BANDS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)
    rise = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(rise, fall), 0, None)


#: Frames whose spectra are held at once; longer texts are handled in overlapping blocks.
BLOCK_FRAMES = 4096
_PHASES, _MEL, _HANN = _phases(), _mel().T.copy(), np.hanning(FRAME + 1)[:-1]


def resample(x: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """x at 2/3 of its rate; len(x) is a multiple of 3. before, after: the samples around it, silence by default."""
    taps = _PHASES.shape[1]
    padded = np.concatenate([np.zeros(taps // 2) if before is None else before, x, np.zeros(taps) if after is None else after])
    out = np.zeros((len(x) // DOWN, UP))
    for p in range(UP):
        shift = p * DOWN // UP
        for k in range(taps):
            out[:, p] += _PHASES[p, k] * padded[shift + k : shift + k + len(x) : DOWN]
    return out.reshape(-1)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Levels (frames x bands, half decibels above -60 dB as bytes) and frame energies in dB."""
    raw, taps = np.frombuffer(samples, np.uint8), _PHASES.shape[1]
    n = len(raw) + -len(raw) % (DOWN * HOP // UP)
    middle = (int(raw.sum(dtype=np.int64)) + 128 * (n - len(raw))) / n if n else 0.0

    def part(a: int, b: int) -> np.ndarray:
        """Samples a to b: what lacks to a whole hop is 128, and silence stands around all."""
        out = np.zeros(b - a)
        lo, hi = max(a, 0), min(b, n)
        out[lo - a : hi - a] = (128 - middle) / 128
        out[lo - a : max(lo, min(hi, len(raw))) - a] = (raw[lo : min(hi, len(raw))] - middle) / 128
        return out

    frames = max(0, (n * UP // DOWN + HOP - FRAME) // HOP + 1)
    levels, energy = [np.zeros((0, BANDS), np.uint8)], [np.zeros(0)]
    for first in range(0, frames, BLOCK_FRAMES):
        last = min(frames, first + BLOCK_FRAMES)
        a, b = first * HOP * DOWN // UP, min(n, ((last - 1) * HOP + FRAME) * DOWN // UP)
        y = resample(part(a, b), part(a - taps // 2, a), part(b, b + taps))
        y = np.concatenate([y, np.zeros((last - first - 1) * HOP + FRAME - len(y))])
        own = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        spectrum = np.fft.rfft(own * _HANN)
        mel = 10 * np.log10((spectrum.real**2 + spectrum.imag**2) @ _MEL + 1e-6)
        energy.append(np.round(10 * np.log10((own * own).mean(1) + 1e-9), 6))
        levels.append(np.clip(np.rint(2 * (mel + 60)), 0, 255).astype(np.uint8))
    return np.concatenate(levels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Active runs of frames [from, to): entered at the high threshold, left below the low one."""
    if not len(energy):
        return []
    middle = np.median(energy)
    state = np.where(energy >= middle + HIGH_DB, 1, np.where(energy < middle + LOW_DB, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.concatenate([[0], np.where(last >= 0, state[last], 0), [0]])
    edge = np.diff(active)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _ms(frame: int) -> float:
    return frame * HOP * 1000 * DOWN / (RATE * UP)


def tensors(levels: np.ndarray) -> bytes:
    """An Arrow stream: one fixed-shape tensor for each TENSOR_FRAMES frames, with start_ms and end_ms."""
    n = max(1, -(-len(levels) // TENSOR_FRAMES))
    full = np.zeros((n, TENSOR_FRAMES, BANDS), np.uint8)
    full.reshape(-1, BANDS)[: len(levels)] = levels
    starts = [_ms(i * TENSOR_FRAMES) for i in range(n)]
    ends = [_ms(min(len(levels), (i + 1) * TENSOR_FRAMES)) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(full), pa.array(starts), pa.array(ends)], ["tensor", "start_ms", "end_ms"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store_text(docs: DataFrame) -> DataFrame:
    """Texts as media in the shared folder: doc_id, n_bytes (without the fill), media."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, out, held = [], [], 0
            at = 0
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                raw = (text or "").encode()
                size.append(len(raw))
                out.append(wav(raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")))
                held += len(out[-1])
                if held > 16 << 20 or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, i + 1 - at), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])
                    size, out, held, at = [], [], 0, i + 1

    return stored(docs.select("doc_id", "text").mapInArrow(fill, "doc_id long, n_bytes long, media binary"), "media", compression="zstd", **{"parquet.block.size": str(16 << 20)})


_FIELDS = [("doc_id", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string")]
_SEGMENTS = ("segments", pa.list_(pa.list_(pa.float64())), "array<array<double>>")
_TENSORS = ("tensors", pa.binary(), "binary")


def _schema(fields: list[tuple[str, pa.DataType, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, _, t in fields)


def store_features(media: DataFrame) -> DataFrame:
    """Per row of (doc_id, n_bytes, media), in the shared folder: digests of what was read back, active segments in ms, the Arrow stream of its tensors."""
    fields = [*_FIELDS, _SEGMENTS, _TENSORS]

    def made(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _, _ in fields])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, n_bytes, item in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), strict=True):
                data = item.as_py()
                payload = wav_samples(data)
                levels, energy = log_mel(payload)
                spans = [[_ms(a), _ms(b)] for a, b in segments(energy)]
                rows.append([doc_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), spans, tensors(levels)])
                held += len(rows[-1][-1])
                if held > 16 << 20 or len(rows) == 1000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return stored(media.select("doc_id", "n_bytes", "media").mapInArrow(compute, _schema(fields)), "tensors", compression="zstd", **{"parquet.block.size": str(16 << 20)})


def stored_levels(stream: bytes) -> np.ndarray:
    """The levels that tensors() was given."""
    table = pa.ipc.open_stream(stream).read_all()
    full = table.column("tensor").combine_chunks().to_numpy_ndarray()
    return full.reshape(-1, BANDS)[: _frame(table.column("end_ms")[-1].as_py())]


def _frame(ms: float) -> int:
    return round(ms / _ms(1))


def from_stored(table: DataFrame, keep_tensors: bool = True) -> DataFrame:
    """store_features() with `feature`, a digest of the stored tensors and segments, and their number of frames."""
    fields = [*_FIELDS, ("feature", pa.string(), "string"), ("n_frames", pa.int64(), "long"), _SEGMENTS] + [_TENSORS] * keep_tensors

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, frames = [], []
            for stream, spans in zip(batch.column("tensors"), batch.column("segments").to_pylist(), strict=True):
                levels = stored_levels(stream.as_py())
                active = [(_frame(a), _frame(b)) for a, b in spans]
                digest.append(hashlib.sha256(levels.tobytes() + repr(active).encode()).hexdigest())
                frames.append(len(levels))
            made = {"feature": pa.array(digest, pa.string()), "n_frames": pa.array(frames, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n, _, _ in fields], [n for n, _, _ in fields])

    return table.mapInArrow(derive, _schema(fields))


def features(media: DataFrame, keep_tensors: bool = True) -> DataFrame:
    """Per row of (doc_id, n_bytes, media): digests of what was read back, active segments in ms, the digest of the stored features, and with keep_tensors the Arrow stream of its tensors."""
    return from_stored(store_features(media), keep_tensors)
