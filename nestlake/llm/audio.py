"""Media columns: texts stored losslessly as 8-bit audio, and features of what is stored.

A payload (UTF-8 bytes, zeros appended up to a positive multiple of 64) becomes the
samples of a mono 8-bit WAV file. The file's bytes are parsed again, and the samples go
through a polyphase resampler (2/3), overlapped log-mel filterbanks and a segmentation
of the frame energy with hysteresis. Features are kept as Arrow fixed-shape tensors of
TENSOR_FRAMES x MELS with the time span of each.

Everything of a document is computed from that document alone, in blocks of bounded
size, so equal texts, ties and repeated rows give equal values. A block is resampled behind the
samples before it and overlaps the next by a frame, so blocks do not show in the result.
The query reads media and tensors back from their stored bytes before it takes digests.
Defined results: a null text counts as empty (64 zero bytes); very long texts only add
blocks; a row without doc_id is kept and has a null doc_id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE, UP, DOWN = 16_000, 2, 3
FRAME, HOP, MELS = 256, 128, 16
TENSOR_FRAMES = 32
#: Samples of one block; a document of any length needs no more memory than a few blocks.
BLOCK = 3 * 64 * 1024
PAD = 64
TAPS = 12
#: Hysteresis: a segment begins above mean + ENTER deviations and ends below mean + LEAVE.
ENTER, LEAVE = 1.0, 0.0


def payload(text: bytes) -> bytes:
    return text + b"\0" * (max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF file of unsigned 8-bit mono samples."""
    odd = len(samples) & 1
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples))
    size = 4 + len(fmt) + len(data) + len(samples) + odd
    return struct.pack("<4sI4s", b"RIFF", size, b"WAVE") + fmt + data + samples + b"\0" * odd


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a file made by ``to_wav``; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono PCM only")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _kernel() -> np.ndarray:
    """Windowed sinc, one row of taps for each phase of the resampler."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(UP, DOWN)
    h = cut * np.sinc(cut * t) * np.hamming(n) * UP
    return np.ascontiguousarray(np.stack([h[p::UP][::-1] for p in range(UP)]))


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - lo) / (mid - lo), (hi - bins) / (hi - mid))).T.copy()


KERNEL = _kernel()
BANK = _mel_bank(RATE * UP / DOWN)
WINDOW = np.hanning(FRAME)


def resample(x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Polyphase: output n takes the taps of phase (n * DOWN) mod UP at input n * DOWN // UP.

    before: the TAPS - 1 samples in front of x, silence if there are none.
    """
    n_out = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1) if before is None else before, x, np.zeros(TAPS)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    y = np.empty(n_out)
    for q in range(UP):
        first, phase = divmod(q * DOWN, UP)
        count = len(range(q, n_out, UP))
        part = windows[first : first + (count - 1) * DOWN + 1 : DOWN] if count else windows[:0]
        y[q::UP] = part @ KERNEL[phase]
    return y


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and log energies of overlapping frames; a short tail is padded with zeros."""
    frames = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(y)))])
    cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:frames]
    power = np.abs(np.fft.rfft(cut * WINDOW, axis=1)) ** 2
    return np.log10(power @ BANK + 1e-6), np.log10((cut * cut).sum(1) + 1e-6)


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel (frames x MELS) and energies, block by block; blocks overlap by one frame."""
    x = np.frombuffer(samples, np.uint8)
    mels, energies = [], []
    step = BLOCK  # a multiple of DOWN, so every block begins on phase 0
    level = lambda part: (part.astype(np.float64) - 128) / 128
    for at in range(0, len(x), step):
        tail = level(x[at : at + step + FRAME * DOWN // UP + DOWN])
        y = resample(tail, level(x[at - TAPS + 1 : at]) if at else None)
        last = at + step >= len(x)
        m, e = log_mel(y)
        keep = len(e) if last else step * UP // DOWN // HOP
        mels.append(m[:keep])
        energies.append(e[:keep])
        if last:
            break
    return np.concatenate(mels), np.concatenate(energies)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open frame ranges: on above the upper threshold, off below the lower, else as before."""
    mean, dev = energy.mean(), energy.std()
    mark = np.zeros(len(energy), np.int8)
    mark[energy >= mean + ENTER * dev] = 1
    mark[energy < mean + LEAVE * dev] = -1
    if dev == 0:
        mark[:] = 1
    at = np.where(mark != 0, np.arange(len(mark)), -1)
    at = np.maximum.accumulate(at)
    on = np.concatenate([[0], (np.where(at >= 0, mark[at], -1) == 1).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(on))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> pa.RecordBatch:
    """Arrow batch: tensor (TENSOR_FRAMES x MELS float32), start_s, end_s. The last is zero-padded."""
    n = -(-len(mel) // TENSOR_FRAMES)
    flat = np.zeros((n * TENSOR_FRAMES, MELS), np.float32)
    flat[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])
    store = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), TENSOR_FRAMES * MELS)
    hop_s = HOP * DOWN / (UP * RATE)
    start = np.arange(n) * TENSOR_FRAMES * hop_s
    end = np.minimum(start + TENSOR_FRAMES * hop_s, len(mel) * hop_s)
    return pa.RecordBatch.from_arrays(
        [pa.ExtensionArray.from_storage(kind, store), pa.array(start), pa.array(end)], ["tensor", "start_s", "end_s"]
    )


def to_ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


COLUMNS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames long, segments array<struct<start_s:double,end_s:double>>"
)


def media_features(df: DataFrame, keep_media: bool = False) -> DataFrame:
    """COLUMNS, and with ``keep_media`` also media (the file) and tensors (Arrow IPC bytes).

    One pass over the texts without a shuffle.
    """
    common.arrow_rows(df.sparkSession)
    span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(span)]
    types += [pa.binary(), pa.binary()] if keep_media else []
    hop_s = HOP * DOWN / (UP * RATE)

    def one(doc: int, text: bytes) -> tuple:
        media = to_wav(payload(text))
        _, samples = from_wav(media)
        mel, energy = features(samples)
        found = [(a * hop_s, b * hop_s) for a, b in segments(energy)]
        stored = to_ipc(tensors(mel))
        kept = from_ipc(stored)
        cells = kept.column("tensor").combine_chunks().storage.flatten().to_numpy()[: mel.size]
        spans = np.stack([kept.column(c).to_numpy() for c in ("start_s", "end_s")])
        digest = zlib.crc32(np.rint(spans * 1e6).astype("<i8").tobytes(), zlib.crc32(np.rint(cells * 1000).astype("<i4").tobytes()))
        feature = f"tensors={kept.num_rows};frames={len(mel)};segments={len(found)};active={sum(b - a for a, b in found):.4f};mel={digest:08x}"
        row = (doc, len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(mel))
        row += ([{"start_s": a, "end_s": b} for a, b in found],)
        return row + ((media, stored) if keep_media else ())

    names = [c.split()[0] for c in COLUMNS.split(", ")] + (["media", "tensors"] if keep_media else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = [one(d, t) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COLUMNS + (", media binary, tensors binary" if keep_media else ""))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(common.table(spark, sf_dir, "documents"))
