"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints.

The WAV files are a written table in the shared folder; sizes, digests and fingerprints are those of the files read back.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, read, whole_text, written

UNIT = 576
PAD = 255
RATE = 8000
FRAME = 576
HOP = 288
#: Frequency bands that give one peak each, and how many frames ahead a peak is paired.
BANDS = (2, 12, 32, 72, 144, 289)
AHEAD = 3

FINGERPRINT = "array<struct<t:int,hash:int>>"


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, padded with 255 to a positive multiple of 576, as an 8-bit mono WAV file."""

    def step(batches):
        for batch in batches:
            data, at = buffer_of(batch.column(1))
            raw = data.tobytes()
            out = []
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                units = max(1, -(-(z - a) // UNIT))
                out.append(to_wav(raw[a:z].ljust(units * UNIT, bytes([PAD]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text)).mapInArrow(step, "doc_id long, n_bytes long, media binary")


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and hashes of pairs of spectral peaks: per frame the strongest bin of each band, paired with the
    other bands' peaks in the frame itself, and with the same and the next band's peak in the frames ahead. A hash holds both
    bins and the distance in frames. A payload of one unit has one frame and so only pairs of the first kind."""
    wave_ = (samples.astype(np.float32) - 128) / 128
    count = max(1, (len(wave_) - FRAME) // HOP + 1)
    peaks = np.empty((count, len(BANDS) - 1), np.int64)
    window = np.hanning(FRAME).astype(np.float32)
    for a in range(0, count, 4096):  # bounded memory for very long ones
        frames = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[a * HOP : (min(a + 4096, count) - 1) * HOP + 1 : HOP]
        power = np.abs(np.fft.rfft(frames * window, axis=1)).round(3)
        for b, (lo, hi) in enumerate(zip(BANDS, BANDS[1:])):
            peaks[a : a + len(frames), b] = power[:, lo:hi].argmax(1) + lo
    t, h = [], []
    for b, c in combinations(range(peaks.shape[1]), 2):
        t.append(np.arange(count))
        h.append(peaks[:, b] << 14 | peaks[:, c] << 4)
    for d in range(1, AHEAD + 1):
        now, then = peaks[:-d], peaks[d:]
        for b in range(peaks.shape[1]):
            for c in (b, b + 1):
                if c < peaks.shape[1]:
                    t.append(np.arange(len(now)))
                    h.append(now[:, b] << 14 | then[:, c] << 4 | d)
    t, h = np.concatenate(t), np.concatenate(h)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def features(media: DataFrame) -> DataFrame:
    """What is read back from stored WAV files: sizes, digests, and the time-coded fingerprint array.

    feature digests the fingerprint array: its number of pairs and the sha256 of its (frame, hash) pairs.
    """

    def step(batches):
        for batch in batches:
            rows, times, hashes = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for body in batch.column(2):
                body = body.as_py()
                payload = from_wav(body)
                t, h = peak_pairs(np.frombuffer(payload, np.uint8))
                times.append(t)
                hashes.append(h)
                feature = f"{len(t)}:{hashlib.sha256(np.stack([t, h], 1).astype('<i4').tobytes()).hexdigest()[:32]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(body), hashlib.sha256(body).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
            pairs = pa.StructArray.from_arrays([np.concatenate(times), np.concatenate(hashes)], ["t", "hash"])
            coded = pa.ListArray.from_arrays(pa.array(np.cumsum([len(t) for t in times]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, coded], NAMES)

    return media.mapInArrow(step, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint {FINGERPRINT}")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"]


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """The stored form of each text and what is read back from it, with the fingerprint array.

    One row per input row. Null and empty texts become one unit of 255. Equal texts give equal values; a null doc_id
    stays null. Texts of any length are taken whole. Other columns are left out. No rows give no rows.
    """
    return features(written(stored(docs, text)))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"))


QUERIES = {"op5_media_columns": op5_media_columns}
