"""Media columns: texts or any bytes as 8-bit audio, and features of that audio.

A payload is stored losslessly as the samples of an 8-bit mono RIFF/WAVE file. Features are taken
from the bytes read back from that file: polyphase resampling, overlapped log-mel filterbanks and
hysteresis energy segmentation. Log-mel frames are stored as fixed-shape Arrow tensors with the time
span of each tensor; spans of sound are stored in seconds.

Edge cases: a null text is empty; an empty payload is padded to 64 zero bytes, so each document has
media; texts of any length are worked through in blocks; equal texts and repeated rows give equal results; an
empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class AudioSpec:
    """Production parameters. Rates in Hz; thresholds in dB relative to full scale."""

    rate: int = 16000
    up: int = 5
    down: int = 8
    taps: int = 12  # of each polyphase branch
    window: int = 256
    hop: int = 128
    mels: int = 24
    frames: int = 16  # of each tensor
    on_db: float = -12.0
    off_db: float = -14.0
    pad_to: int = 64
    block: int = 4096  # frames worked on at once

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def to_wav(payload: bytes, rate: int) -> bytes:
    """8-bit unsigned mono PCM in a RIFF container; an odd payload gets the format's pad byte."""
    pad = len(payload) & 1
    return HEADER.pack(b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def from_wav(media: bytes) -> bytes:
    """The samples of a file that to_wav wrote, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@lru_cache
def branches(spec: AudioSpec) -> np.ndarray:
    """The windowed-sinc low-pass, dealt to its `up` polyphase branches; each branch sums to 1."""
    n = spec.taps * spec.up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(spec.up, spec.down)
    h = (np.sinc(t * cut) * np.hamming(n)).reshape(spec.taps, spec.up).T
    return np.ascontiguousarray((h / h.sum(axis=1, keepdims=True)).astype(np.float32))


@lru_cache
def mel_bank(spec: AudioSpec) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, from 0 Hz to half the rate; (bins, mels)."""
    mel = np.linspace(0, 2595 * np.log10(1 + spec.out_rate / 2 / 700), spec.mels + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(spec.window, 1 / spec.out_rate)[:, None]
    left, mid, right = hz[:-2], hz[1:-1], hz[2:]
    bank = np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid)))
    return bank.astype(np.float32)


def resample(samples: np.ndarray, spec: AudioSpec, first: int, last: int) -> np.ndarray:
    """Output samples first..last-1. Output m is branch (m*down mod up) over the inputs that end at m*down div up; silence surrounds the signal."""
    bank, k = branches(spec), spec.taps
    lo = first * spec.down // spec.up - k + 1 + k // 2
    hi = (last - 1) * spec.down // spec.up + 1 + k // 2
    x = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(samples))
    if b > a:
        x[a - lo : b - lo] = samples[a:b]
        x[a - lo : b - lo] -= 128
        x[a - lo : b - lo] /= 128
    windows = np.lib.stride_tricks.sliding_window_view(x, k)
    out = np.empty(last - first, np.float32)
    for p in range(min(spec.up, last - first)):
        m = first + p
        at = m * spec.down // spec.up - k + 1 + k // 2 - lo
        n = len(range(m, last, spec.up))
        out[p :: spec.up] = windows[at : at + (n - 1) * spec.down + 1 : spec.down] @ bank[m * spec.down % spec.up][::-1]
    return out


def hysteresis(db: np.ndarray, spec: AudioSpec, on: bool) -> np.ndarray:
    """True from a frame of on_db or more until one under off_db; `on` is the state before."""
    mark = np.where(db >= spec.on_db, 1, np.where(db < spec.off_db, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(db)), -1))
    return np.where(at >= 0, mark[at], int(on)).astype(bool)


def features(payload: bytes, spec: AudioSpec) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Log-mel frames (frames, mels) and the spans of sound in seconds. The last frame is filled up with silence."""
    samples = np.frombuffer(payload, np.uint8)
    n = -(-len(samples) * spec.up // spec.down)
    frames = max(1, -(-max(0, n - spec.window) // spec.hop) + 1)
    shape, bank = np.hanning(spec.window).astype(np.float32), mel_bank(spec)
    mels, spans, on, begun = np.empty((frames, spec.mels), np.float32), [], False, 0.0
    for a in range(0, frames, spec.block):
        b = min(a + spec.block, frames)
        y = resample(samples, spec, a * spec.hop, (b - 1) * spec.hop + spec.window)
        cut = np.lib.stride_tricks.sliding_window_view(y, spec.window)[:: spec.hop]
        cut = cut - cut.mean(axis=1, keepdims=True)
        db = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", cut, cut) / spec.window, 1e-10))
        power = np.abs(np.fft.rfft(cut * shape, axis=1)).astype(np.float32) ** 2
        mels[a:b] = np.log10(np.maximum(power @ bank, 1e-10))
        state = hysteresis(db, spec, on)
        for i in np.flatnonzero(np.diff(state, prepend=on)):
            t = (a + int(i)) * spec.hop / spec.out_rate
            if state[i]:
                begun = t
            else:
                spans.append((begun, t))
        on = bool(state[-1])
    if on:
        spans.append((begun, ((frames - 1) * spec.hop + spec.window) / spec.out_rate))
    return mels, spans


def tensor_ipc(mels: np.ndarray, spec: AudioSpec) -> bytes:
    """An Arrow stream of (start_s, end_s, n_frames, mel: fixed_shape_tensor[frames, mels]); the last tensor is filled up with its floor, -10."""
    n = -(-len(mels) // spec.frames)
    full = np.full((n * spec.frames, spec.mels), -10, np.float32)
    full[: len(mels)] = mels
    first = np.arange(n) * spec.frames
    valid = np.minimum(spec.frames, len(mels) - first)
    kind = pa.fixed_shape_tensor(pa.float32(), (spec.frames, spec.mels))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), spec.frames * spec.mels)
    table = pa.record_batch({"start_s": first * spec.hop / spec.out_rate,
        "end_s": ((first + valid - 1) * spec.hop + spec.window) / spec.out_rate, "n_frames": valid,
        "mel": pa.ExtensionArray.from_storage(kind, storage)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    """The table that tensor_ipc wrote."""
    return pa.ipc.open_stream(data).read_all()


SCHEMA = "{id} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, tensors binary, spans array<struct<start_s: double, end_s: double>>, feature string"


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: AudioSpec = AudioSpec()) -> DataFrame:
    """Stores each text as audio and adds the features of the stored audio.

    Returns id_col, n_bytes (unpadded), payload_bytes, payload_sha256 and tail_crc32 (of the last
    pad_to bytes), both from the payload read back, media (the WAVE file), tensors (read_tensors),
    spans of sound and a one-line summary, feature. No shuffle; memory is bounded by one text.
    """
    common.prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(id=id_col, kind=kind)

    def run(batches):
        common.trim()
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for whole in batches:
            for batch in common.slices(whole, "text", 2 << 20):
                rows = []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    text = text or b""
                    payload = text + b"\0" * (-len(text) % spec.pad_to or (0 if text else spec.pad_to))
                    media = to_wav(payload, spec.rate)
                    back = from_wav(media)
                    mels, spans = features(back, spec)
                    mean, high = round(float(mels.mean()), 2) + 0.0, round(float(mels.max()), 2) + 0.0
                    said = f"frames={len(mels)};tensors={-(-len(mels) // spec.frames)}x{spec.frames}x{spec.mels};mean={mean:.2f};max={high:.2f};spans={len(spans)};sound_s={sum(b - a for a, b in spans):.3f}"
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-spec.pad_to :]), media,
                        tensor_ipc(mels, spec), [{"start_s": a, "end_s": b} for a, b in spans], said))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), span, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "tensors", "spans", "feature"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op1_audio_media(spark, sf_dir: str) -> DataFrame:
    """Every document as audio: digests of the payload read back and of the stored form, and a summary of the features."""
    out = audio_features(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.octet_length("tensors").cast("long").alias("tensor_bytes"), F.size("spans").cast("long").alias("n_spans"))
