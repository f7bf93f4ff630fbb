"""Media columns: texts as 8-bit WAV samples, short-time spectra and spectral-peak pair fingerprints.

Each row's payload is stored as a mono 8-bit WAV file in a binary column of a Parquet table. Reading the
table back, each file is opened with the wave module, framed, windowed and transformed, the two strongest
spectral peaks of each frame are paired with each other and with the strongest peaks of the next frames.

Defined cases: very long texts are files of their own size, framed in blocks; of peaks of equal power the lower bin comes first; null and empty texts are 64 zero bytes; repeated rows give repeated rows with equal values;
a silent or constant frame has no peaks; an empty table gives an empty table; other columns are ignored.
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

from spindrift.llm.common import staged, steps, text_bytes

RATE, FRAME, HOP, REACH = 8000, 256, 128, 2
UNIT = 64
WINDOW = np.hanning(FRAME).astype(np.float32)
FRAMES_AT_ONCE = 1 << 13


def payload_of(raw: bytes) -> bytes:
    """raw, zero-padded to a positive multiple of UNIT."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored)) as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two strongest local spectral maxima of each frame, as frequency bins (0: none), and their frames' count."""
    n = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    padded = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    out = np.zeros((n, 2), np.int64)
    for i in range(0, n, FRAMES_AT_ONCE):
        part = (frames[i : i + FRAMES_AT_ONCE].astype(np.float32) - 128) * WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)) ** 2
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1), inner, 0)
        rows = np.arange(len(top))
        for k in range(2):
            best = top.argmax(axis=1)
            out[i : i + len(top), k] = np.where(top[rows, best] > 0, best + 1, 0)
            top[rows, best] = 0
    return out, np.arange(n)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded peak pairs: frame << 16 | first bin << 9 | second bin << 2 | frames between, ascending by frame."""
    at, time = peaks(samples)
    both = (at > 0).all(axis=1)
    codes = [(time[both] << 16) | (at[both, 0] << 9) | (at[both, 1] << 2)]
    for dt in range(1, REACH + 1):
        for k in range(2):
            a, b = at[: len(at) - dt, k], at[dt:, 0]
            ok = (a > 0) & (b > 0)
            codes.append((time[: len(at) - dt][ok] << 16) | (a[ok] << 9) | (b[ok] << 2) | dt)
    return np.sort(np.concatenate(codes))


def store(spark: SparkSession, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's WAV file, written to a table in the shared folder and read back."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in steps(text_bytes(batch.column(1))[1], 8 << 20):
                raw = [x or b"" for x in batch.column(1).slice(i, j - i).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(payload_of(x)) for x in raw], pa.binary())], ["key", "n_bytes", "media"])

    kind = rows.schema[key].dataType.simpleString()
    return staged(spark, rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(encode, f"key {kind}, n_bytes long, media binary"), "media").withColumnRenamed("key", key)


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """From stored files: payload facts, file facts, spectrum counts and the fingerprint array."""
    kind = media.schema[key].dataType.simpleString()
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "fingerprint"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in steps(text_bytes(batch.column(2))[1], 4 << 20):
                part = batch.slice(i, j - i)
                got: list[list] = [[] for _ in range(7)]
                for stored in part.column(2).to_pylist():
                    payload = from_wav(stored)
                    samples = np.frombuffer(payload, np.uint8)
                    for column, value in zip(got, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), 1 + max(0, -(-(len(payload) - FRAME) // HOP)), fingerprint(samples)), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], names)

    return media.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(decode, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, fingerprint array<long>").withColumnRenamed("key", key)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.common import documents

    found = features(store(spark, documents(spark, sf_dir)))
    pairs = F.size("fingerprint")
    digest = F.sha2(F.array_join(F.transform("fingerprint", lambda x: F.hex(x)), ",").cast("binary"), 256)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", F.col("n_frames").cast("string"), pairs.cast("string"), F.substring(digest, 1, 32)).alias("feature"))
