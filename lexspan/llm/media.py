"""Audio columns: 8-bit WAV clips, polyphase resampling, overlapped log-mel filterbanks and segments by hysteresis of energy,
stored as fixed-shape Arrow tensors with time spans.

Three tables are written in turn to the shared folder: the clips; each clip's tensors and segments, from the clip as it is read back;
and, from the tensors as they are read back, its features are made. A clip is resampled by L/M with one matrix product: M inputs and the filter's tails give L outputs, one filter phase each.
Frames overlap by half. A segment is a run of frames above the lower threshold that rises above the upper one. The log-mel
frames of a clip are dealt into patches of FRAMES x MELS (the last padded with silence, its span says where it ends) as an
Arrow IPC stream of a `fixed_shape_tensor` column with start and end in seconds.

Defined results. A null or empty payload is one block of padding. Equal payloads have equal media, tensors and features.
A null doc_id stays null. Repeated rows are each stored. Only the id and the payload are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexspan.llm.common import materialize, table, text_slices, tidy

RATE, UP, DOWN, TAPS = 8000, 4, 5, 16
FRAME, HOP, MELS, FRAMES = 256, 128, 32, 64
#: Decibels above a clip's median energy at which a segment starts, and below which it ends.
HIGH_DB, LOW_DB = 3.0, 1.0
FLOOR = 1e-10
BLOCK, FILL = 576, 255


def payload(raw: bytes, block: int = BLOCK, fill: int = FILL) -> bytes:
    """raw, filled up to a positive multiple of the block."""
    return raw + bytes([fill]) * (max(1, -(-len(raw) // block)) * block - len(raw))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = len(samples) & 1
    size = lambda n: n.to_bytes(4, "little")
    head = b"RIFF" + size(36 + len(samples) + pad) + b"WAVEfmt " + size(16) + b"\x01\x00\x01\x00" + size(rate) + size(rate) + b"\x01\x00\x08\x00"
    return head + b"data" + size(len(samples)) + samples + b"\0" * pad


def unwav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file as wav() writes it, other chunks skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            if media[at + 8 : at + 12] != b"\x01\x00\x01\x00" or media[at + 22 : at + 24] != b"\x08\x00":
                raise ValueError("not mono 8-bit PCM")
            rate = int.from_bytes(media[at + 12 : at + 16], "little")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


@cache
def _resampler(up: int, down: int, taps: int) -> tuple[np.ndarray, int]:
    """(window, up): what each of the `up` outputs takes from a window of inputs; and how far windows reach back."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    low_pass = np.sinc(t / max(up, down)) * np.hamming(n) * min(1.0, up / down)
    wide = taps + down
    out = np.zeros((wide, up), np.float32)
    for r in range(up):
        at, phase = divmod(r * down, up)
        own = low_pass[phase::up]
        out[at : at + taps, r] = own[::-1] / own.sum()
    return out, taps - 1


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, chunk: int = 1 << 18) -> np.ndarray:
    """x at up/down of its rate: ceil(len(x) * up / down) samples."""
    filters, back = _resampler(up, down, taps)
    groups = -(-len(x) // down)
    padded = np.zeros(groups * down + len(filters) + back, np.float32)
    half = back // 2
    padded[back - half : back - half + len(x)] = x
    rows = np.lib.stride_tricks.sliding_window_view(padded, len(filters))[::down][:groups]
    parts = [np.ascontiguousarray(rows[i : i + chunk]) @ filters for i in range(0, groups, chunk)]
    return np.concatenate(parts).reshape(-1)[: -(-len(x) * up // down)]


@cache
def _filterbank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles, even on the mel scale from 0 to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: float, chunk: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energies (dB) of half overlapped frames, one at least."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(y)] = y[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), _filterbank(rate, FRAME, MELS)
    rows, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, chunk):
        spectrum = np.fft.rfft(frames[i : i + chunk] * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        rows[i : i + chunk] = np.log(np.maximum(power @ bank, FLOOR))
        energy[i : i + chunk] = 10 * np.log10(np.maximum(power.mean(1), FLOOR))
    return rows, energy


def segments(energy: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Half-open ranges of frames: runs above the lower threshold in which the upper one is reached."""
    base = float(np.median(energy))
    on = np.concatenate(([False], energy > base + low, [False]))
    edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    loud = np.concatenate(([0], np.cumsum(energy > base + high)))
    return [(int(a), int(b)) for a, b in edge if loud[b] > loud[a]]


TENSOR = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS), dim_names=["frame", "mel"])
PATCH = pa.schema([("patch", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tensors(rows: np.ndarray, rate: float) -> bytes:
    """Arrow IPC stream of the patches of a clip."""
    n = -(-len(rows) // FRAMES)
    full = np.full((n * FRAMES, MELS), np.log(FLOOR), np.float16)
    full[: len(rows)] = rows
    start = np.arange(n) * FRAMES * HOP / rate
    end = np.minimum((np.arange(1, n + 1)) * FRAMES, len(rows)) * HOP / rate
    patch = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PATCH) as out:
        out.write_batch(pa.record_batch([patch, pa.array(start), pa.array(end)], schema=PATCH))
    return sink.getvalue().to_pybytes()


def read_tensors(raw: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Patches (n, FRAMES, MELS) of logarithms and spans of what tensors() wrote."""
    t = pa.ipc.open_stream(raw).read_all().combine_chunks()
    patches = t["patch"].combine_chunks().to_numpy_ndarray()
    return patches.astype(np.float32), list(zip(t["start_s"].to_pylist(), t["end_s"].to_pylist(), strict=True))


def clip_tensors(media: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """Tensors and segments in seconds of a stored clip."""
    samples, rate = unwav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y, at = resample(x), rate * UP / DOWN
    rows, energy = log_mel(y, at)
    return tensors(rows, at), [(a * HOP / at, b * HOP / at) for a, b in segments(energy)]


def described(stored: bytes, spans: list[tuple[float, float]], rate: float = RATE * UP / DOWN) -> str:
    """A short description of a clip from its stored tensors and segments."""
    patches, places = read_tensors(stored)
    n = round(places[-1][1] * rate / HOP)
    rows = patches.reshape(-1, MELS)[:n].astype(np.float64)
    energy = 10 * np.log10(np.exp(rows).mean(1)).mean()
    mean = rows.mean(0).reshape(8, -1).mean(1)
    loud = sum(b - a for a, b in spans) * rate / HOP
    return f"frames={n};segments={len(spans)};loud={loud:.0f};energy={energy:.2f};mel={','.join(f'{v:.2f}' for v in mean)}"


def store_audio(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text's padded UTF-8 bytes as a WAV file. Written to the shared folder."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, media = [], []
            for raw in text_slices(b["text"]):
                n.append(len(raw))
                media.append(wav(payload(raw)))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(wanted.mapInArrow(run, "id long, n_bytes long, media binary"), "media", "zstd")


STORED = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<struct<start_s:double,end_s:double>>, tensors binary"


def store_tensors(stored: DataFrame) -> DataFrame:
    """What is read back from stored clips, their segments, and their tensors (see read_tensors). Written to the shared folder."""
    arrow = to_arrow_schema(StructType.fromDDL(STORED))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b["id"].to_pylist(), b["n_bytes"].to_pylist()
            for at in range(0, b.num_rows, 64):
                rows = []
                for i in range(at, min(at + 64, b.num_rows)):
                    media = b["media"][i].as_buffer().to_pybytes()
                    samples, _ = unwav(media)
                    made, spans = clip_tensors(media)
                    rows.append({
                        "id": ids[i], "n_bytes": sizes[i], "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(),
                        "tail_crc32": zlib.crc32(samples[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                        "segments": [{"start_s": x, "end_s": y} for x, y in spans], "tensors": made,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return materialize(stored.mapInArrow(run, STORED), "media-tensors", "zstd")


def audio_features(stored: DataFrame) -> DataFrame:
    """store_tensors() of stored clips, and feature, a description of each made from its stored tensors."""
    schema = StructType.fromDDL(f"{STORED}, feature string")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = ([(s["start_s"], s["end_s"]) for s in x] for x in b["segments"].to_pylist())
            said = [described(x.as_buffer(), y) for x, y in zip(b["tensors"], spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in schema.names[:-1]), pa.array(said, pa.string())], schema=to_arrow_schema(schema))

    return store_tensors(stored).mapInArrow(run, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(store_audio(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments")
