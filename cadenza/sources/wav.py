"""WAV files as DataFrames, and back: scan, decode, frames, chunks, encode."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATE, FRAME = 16_000, 512
#: Output samples that a resampling step makes at once.
STEP = 1 << 16


@lru_cache(maxsize=16)
def _low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc of ten periods to either side, Kaiser 5, that passes up in all."""
    most = max(up, down)
    reach = 10 * most
    at = np.arange(-reach, reach + 1)
    taps = np.sinc(at / most) * np.kaiser(2 * reach + 1, 5.0)
    return taps * (up / taps.sum())


def resample(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """Polyphase resampling: ceil(n * rate / own) samples; what lies outside of the signal counts as zeros."""
    if own == rate or not len(x):
        return np.asarray(x, float)
    up, down = rate // gcd(own, rate), own // gcd(own, rate)
    taps = _low_pass(up, down)
    reach, n = len(taps) // 2, -(-len(x) * up // down)
    out, held = np.empty(n), np.arange(-(-2 * reach // up) + 1)
    for lo in range(0, n, STEP):
        m = np.arange(lo, min(n, lo + STEP))[:, None] * down
        k = -((reach - m) // up) + held  # samples under the taps
        place = m - k * up + reach
        fits = (k >= 0) & (k < len(x)) & (place >= 0) & (place < len(taps))
        out[lo : lo + len(m)] = (np.where(fits, np.asarray(x, float)[k.clip(0, len(x) - 1)], 0) * taps[place.clip(0, len(taps) - 1)]).sum(1)
    return out


def resample_linear(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """Linear interpolation at int(n * rate / own) places from the first sample to one past the last."""
    return x if own == rate or not len(x) else np.interp(np.linspace(0, len(x), int(len(x) * rate / own)), np.arange(len(x)), x)


def mono(x: np.ndarray) -> np.ndarray:
    """float32, the mean over the shorter axis; 16- and 32-bit integers over their range."""
    x = np.asarray(x)
    full = {np.dtype(np.int16): 32768.0, np.dtype(np.int32): 2147483648.0}.get(x.dtype, 1.0)
    if x.ndim == 2:
        x = x.mean(1 if x.shape[1] <= x.shape[0] else 0)
    return (x / full).astype(np.float32)


def decode_wav(raw: bytes, rate: int = RATE, mode: str = "whole") -> np.ndarray:
    """Mono float32 samples at the given rate.

    mode ``whole``: samples of 8, 16, 24 or 32 bits, all channels averaged, polyphase resampling, divided by
    the peak only if that is over 1. ``int16``: the bytes are taken as 16-bit samples whatever the header
    says, ``int8``: as 16-bit ones or else as signed 8-bit ones; either averages two channels only and resamples linearly.
    """
    with wave.open(io.BytesIO(raw)) as file:
        width, channels, own = file.getsampwidth(), file.getnchannels(), file.getframerate()
        data = file.readframes(file.getnframes())
    if mode != "whole":
        narrow = mode == "int8" and width != 2
        x = np.frombuffer(data[: len(data) if narrow else len(data) // 2 * 2], "i1" if narrow else "<i2") / (128.0 if narrow else 32768.0)
        x = x.reshape(-1, 2).mean(1) if channels == 2 else x
        return resample_linear(x, own, rate).astype(np.float32)
    if width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
    else:
        x = {1: lambda: (np.frombuffer(data, np.uint8) - 128.0) / 128, 2: lambda: np.frombuffer(data, "<i2") / 32768.0, 4: lambda: np.frombuffer(data, "<i4") / 2147483648.0}[width]()
    x = resample(x.reshape(-1, channels).mean(1), own, rate)
    peak = np.abs(x).max(initial=0)
    return (x / peak if peak > 1 else x).astype(np.float32)


def _wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit PCM; samples are clipped to [-1, 1], then scaled."""
    return _wav(np.clip(np.asarray(samples, float), -1, 1) * 32767, rate)


def clip_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit PCM for evidence clips; samples are scaled, then clipped to the 16-bit range, so that -1.01 is lower than -1."""
    return _wav(np.clip(mono(samples) * np.float32(32767), -32768, 32767), rate)


def read_recordings(spark: SparkSession, folder: str, rate: int = RATE, without: str | None = None, mode: str = "whole") -> DataFrame:
    """recording_id, path, samples of each .wav file of a folder (any case); without: the name of a file that is left out. A folder without such files is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if without:
        files = files.where(F.col("name") != without)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no WAV files in {folder}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"recording_id": batch["recording_id"], "path": batch["path"], "samples": [decode_wav(c, rate, mode) for c in batch["content"]]})

    named = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("recording_id"), "path", "content")
    return named.mapInPandas(run, "recording_id string, path string, samples array<float>")


def frames_of(recordings: DataFrame, size: int = FRAME, hop: int | None = None) -> DataFrame:
    """recording_id, frame_idx, ts, samples: whole frames only."""
    hop = hop or size
    n = F.floor((F.size("samples") - size) / hop).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("samples", i * hop + 1, size))
    whole = recordings.where(F.size("samples") >= size).select("recording_id", F.posexplode(cut).alias("frame_idx", "samples"))
    return whole.select("recording_id", "frame_idx", (F.col("frame_idx") * hop / RATE).alias("ts"), "samples")


def chunks_of(recordings: DataFrame, seconds: float, least_seconds: float | None = None) -> DataFrame:
    """recording_id, chunk, samples: a recording in chunks; a last one that is shorter than least_seconds (by default than a whole chunk) goes. Without a chunk the recording is one."""
    size = int(seconds * RATE)
    least = size if least_seconds is None else int(least_seconds * RATE)
    last = F.greatest(F.ceil(F.size("samples") / size).cast("int") - 1, F.lit(0))
    cut = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("samples", i * size + 1, size)), lambda c: F.size(c) >= least)
    return recordings.select("recording_id", F.posexplode(F.when(F.size(cut) > 0, cut).otherwise(F.array("samples"))).alias("chunk", "samples"))


def rechunked(blocks: DataFrame, size: int = FRAME) -> DataFrame:
    """recording_id, frame_idx, samples: blocks of any lengths (recording_id, block_idx, samples) as whole frames of one length; what is left over goes."""
    before = Window.partitionBy("recording_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_start", F.coalesce(F.sum(F.size("samples")).over(before), F.lit(0)))
    single = placed.select("recording_id", "_start", F.posexplode("samples").alias("_i", "x")).withColumn("_at", F.col("_start") + F.col("_i"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "x"))), lambda s: s["x"])
    return single.groupBy("recording_id", F.floor(F.col("_at") / size).alias("frame_idx")).agg(ordered.alias("samples")).where(F.size("samples") == size)


def keep_segments(samples: Column, segments: Column) -> Column:
    """samples where one of the segments (array of structs start, end: sample numbers, end exclusive) holds them, else 0; same length."""
    return F.transform(samples, lambda x, i: F.when(F.exists(segments, lambda s: (i >= s["start"]) & (i < s["end"])), x).otherwise(F.lit(0.0).cast("float")))


def speaker_recordings(recordings: DataFrame, segments: DataFrame, size: int = FRAME) -> DataFrame:
    """recording_id, speaker_id, samples: a recording for each speaker, of the original length and silent outside of its segments (recording_id, speaker_id, start_frame, end_frame)."""
    held = segments.groupBy("recording_id", "speaker_id").agg(F.collect_list(F.struct((F.col("start_frame") * size).alias("start"), (F.col("end_frame") * size).alias("end"))).alias("_held"))
    return recordings.join(held, "recording_id").select("recording_id", "speaker_id", keep_segments(F.col("samples"), F.col("_held")).alias("samples"))


def encoded(recordings: DataFrame, name: Column) -> DataFrame:
    """name and content (WAV bytes) of each row's samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "content": [encode_wav(np.asarray(s)) for s in batch["samples"]]})

    return recordings.select(name.alias("name"), "samples").mapInPandas(run, "name string, content binary")


def proof_name(index: Column, kind: Column, seconds: Column) -> Column:
    """The file name of an event's evidence clip."""
    return F.format_string("%03d_%s_%.1fs.wav", index.cast("int"), kind, seconds.cast("double"))


def write_clips(clips: DataFrame, path: str) -> None:
    """name and content (WAV bytes) of each row as Parquet under path: one dataset, no file for each clip."""
    clips.select("name", "content").write.mode("overwrite").parquet(path)
