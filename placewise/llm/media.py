"""Media columns: texts kept as 8-bit audio, read back, and described by audio features.

A payload becomes the data chunk of a WAV file (mono, 8-bit unsigned, 16 kHz). From the samples read back:
polyphase resampling to 8 kHz, overlapped frames, log-mel filterbanks, and energy segments by hysteresis (a
segment opens above the upper level and lasts while the energy stays above the lower one). The features of each
segment are a fixed-shape Arrow tensor (PATCH x MELS) with the segment's time span; a long segment's frames are
averaged into its PATCH rows. Tensors and spans are stored as Arrow IPC bytes in a binary column, since Spark's own
columns have no such type.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm.common import table

BLOCK = 192
RATE, TO_RATE = 16000, 8000
FRAME, OFFSET, MELS, PATCH = 256, 128, 16, 8
#: Hysteresis: levels in dB above the clip's median frame energy.
OPEN_DB, CLOSE_DB = 1.5, 0.5
#: Samples that one step of resampling and framing takes.
SAMPLES_AT_ONCE = 1 << 17
TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))

_N = np.arange(-24, 25)
_LOWPASS = (np.sinc(_N / 2) / 2 * np.hamming(len(_N))).astype(np.float32)
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(TO_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / TO_RATE)
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_BANK = _mel_bank()


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 and its length, with spaces up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def store(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, len(data), "NONE", "not compressed"))
        w.writeframes(data)
    return out.getvalue()


def read(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def resample(samples: np.ndarray) -> np.ndarray:
    """Half the rate by the two phases of the low-pass filter, each over every second sample."""
    half = len(_LOWPASS) // 2
    x = np.concatenate((np.full(half, samples[0]), samples, np.full(half + 1, samples[-1]))) if len(samples) else samples
    n = -(-len(samples) // 2)
    out = np.zeros(n, np.float32)
    for phase in (0, 1):
        part, taps = x[phase::2], _LOWPASS[phase::2]
        out += np.convolve(part, taps[::-1], "valid")[:n]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and each frame's energy in dB; the last frame is filled up with zeros."""
    n = 1 + max(0, -(-(len(samples) - FRAME) // OFFSET))
    x = np.concatenate((samples, np.zeros((n - 1) * OFFSET + FRAME - len(samples), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::OFFSET]
    mels, energy = [], []
    for i in range(0, n, SAMPLES_AT_ONCE // FRAME):
        part = frames[i : i + SAMPLES_AT_ONCE // FRAME]
        spectrum = np.fft.rfft(part * _WINDOW, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(power @ _BANK + np.float32(1e-6)))
        energy.append(10 * np.log10(power.mean(axis=1) + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames above the lower level that reach the upper one; the whole clip if there is none."""
    level = float(np.median(energy))
    low = np.concatenate(([False], energy > level + CLOSE_DB, [False]))
    edges = np.flatnonzero(low[1:] != low[:-1])
    reaches = np.concatenate(([0], np.cumsum(energy > level + OPEN_DB)))
    found = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if reaches[b] > reaches[a]]
    return found or [(0, len(energy))]


def patches(mels: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Each span's frames averaged into PATCH rows; a shorter span repeats frames."""
    sums = np.concatenate((np.zeros((1, MELS)), np.cumsum(mels, axis=0, dtype=np.float64)))
    s = np.array(spans)
    edge = s[:, :1] + (s[:, 1:] - s[:, :1]) * np.arange(PATCH + 1)[None, :] // PATCH
    a = np.minimum(edge[:, :-1], len(mels) - 1)
    b = np.maximum(edge[:, 1:], a + 1)
    return ((sums[b] - sums[a]) / (b - a)[:, :, None]).astype(np.float32)


def features(media: bytes) -> tuple[pa.FixedShapeTensorArray, list[tuple[float, float]]]:
    """A tensor and a time span in seconds for each segment of the stored clip."""
    samples = (np.frombuffer(read(media), np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(samples - samples.mean()))
    spans = segments(energy)
    flat = pa.array(patches(mels, spans).reshape(-1), pa.float32())
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, PATCH * MELS))
    return tensors, [(a * OFFSET / TO_RATE, b * OFFSET / TO_RATE) for a, b in spans]


_STORED = pa.schema([("tensor", TENSOR), ("start", pa.float64()), ("end", pa.float64())])


def store_features(tensors: pa.FixedShapeTensorArray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow IPC stream of one batch: a fixed-shape tensor and its time span for each segment."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _STORED) as w:
        w.write_batch(pa.RecordBatch.from_arrays([tensors, pa.array([a for a, _ in spans], pa.float64()), pa.array([b for _, b in spans], pa.float64())], schema=_STORED))
    return out.getvalue().to_pybytes()


def read_features(stored: bytes) -> tuple[pa.FixedShapeTensorArray, list[tuple[float, float]]]:
    """What store_features() stored, without a copy of the tensors."""
    batch = pa.ipc.open_stream(stored).read_next_batch()
    return batch.column(0), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))


def describe(tensors: pa.FixedShapeTensorArray, spans: list[tuple[float, float]]) -> str:
    """Segments, seconds, mean log-mel bands, and a digest of all tensors and spans (rounded, so that it doesn't hang on the last bits)."""
    x = tensors.to_numpy_ndarray()
    digest = hashlib.sha256(np.round(x, 2).astype("<f4").tobytes() + np.array(spans, "<f8").tobytes()).hexdigest()[:16]
    bands = ",".join(f"{v:.2f}" for v in x.mean(axis=(0, 1)))
    return f"segments={len(spans)};seconds={sum(b - a for a, b in spans):.3f};mel={bands};digest={digest}"


def audio_columns(docs: DataFrame, text: str = "text", keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, media (the stored clip; null unless keep_media) and features (its tensors and time spans as
    store_features() stores them: an Arrow IPC stream of the fixed-shape tensor type, for read_features()).

    A null text counts as empty: its payload is one block of spaces. Equal texts give equal values, repeated rows are
    kept. An empty table gives an empty result; other columns don't matter.
    """
    schema = docs.select("doc_id").schema.simpleString()[7:-1] + ", n_bytes bigint, media binary, features binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = {"n_bytes": [], "media": [], "features": []}
                for t in part.column(1).to_pylist():
                    data, n = payload(t)
                    media = store(data)
                    rows["n_bytes"].append(n)
                    rows["media"].append(media if keep_media else None)
                    rows["features"].append(store_features(*features(media)))
                kinds = {"n_bytes": pa.int64(), "media": pa.binary(), "features": pa.binary()}
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, kinds[k]) for k, v in rows.items()]], ["doc_id", *rows])

    return docs.select("doc_id", text).mapInArrow(build, schema)


def audio_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """What audio_columns() stores, read back, as digests: nothing but sizes, checksums and a feature string leaves the task.

    A row per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null
    texts, equal texts, repeated rows, empty tables and other columns are as there.
    """
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    schema = docs.select("doc_id").schema.simpleString()[7:-1] + ", n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                data, n = payload(t.as_py())
                media = store(data)
                back = read(media)
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(*read_features(store_features(*features(media))))))
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]], ["doc_id", *kinds])

    return docs.select("doc_id", text).mapInArrow(digest, schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
