"""Numeric kernels over a matrix of frames, in numpy; one Arrow pass computes every feature of a frame.

Frames are rows of 16 kHz samples. Nothing is subtracted from them: an offset counts as energy and as
periodicity. A frame of zeros has no pitch, no band and a harmonicity of -100 dB.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

RATE, FRAME = 16_000, 512
#: Rows whose features a task makes at once.
ROWS = 512
#: Samples from a frame's start that a pitch is taken of.
CONTEXT = 2048
TINY = 1e-10
FEATURES = ("rms", "band_ratio", "speech_ratio", "peak_ratio", "flatness", "full_flatness", "hnr_db", "f0_hz", "centroid", "rolloff", "zcr", "mfcc1", "mfcc2")

# Fixed values: (bands, low Hz, high Hz) of the three sets of cepstral coefficients.
SMALL_MEL, SEGMENT_MEL, VOICE_MEL = (12, 80, 4000), (26, 80, 7600), (40, 80, 8000)


@lru_cache(maxsize=8)
def mel_matrix(bands: int, low: float, high: float, size: int = FRAME) -> np.ndarray:
    """Triangular filters, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / RATE)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2] + TINY)[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1] + TINY)[:, None]
    return np.maximum(0, np.minimum(up, down))


def magnitudes(x: np.ndarray) -> np.ndarray:
    """Of the spectrum of each row under a Hann window."""
    return np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), axis=1))


def cepstrum(power: np.ndarray, mel: tuple[int, float, float], coefficients: range) -> np.ndarray:
    """(rows, coefficients): cosine transform of the logarithms of mel bands."""
    bands = mel[0]
    logs = np.log(power @ mel_matrix(*mel, 2 * (power.shape[1] - 1)).T + TINY)
    return logs @ np.cos(np.pi * np.outer(np.arange(bands) + 0.5, np.array(coefficients)) / bands)


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Of each row, over its value at lag 0, by a zero-padded FFT."""
    n = x.shape[1]
    r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2)[:, :n]
    return r / (r[:, :1] + TINY)


def harmonicity(r: np.ndarray, low: int = 32, high: int = 200) -> np.ndarray:
    """dB of the periodic part over the rest, from normalised autocorrelations, at lags in [low, high)."""
    p = r[:, low:high].max(1).clip(0, 1 - TINY)
    return 10 * np.log10(p / (1 - p + TINY) + TINY)


def pitch(r: np.ndarray, low: int = 40, high: int = 200, least: float = 0.3) -> np.ndarray:
    """Hz of the strongest lag in [low, high), 0 where it is weaker than least."""
    lag = r[:, low:high].argmax(1) + low
    return np.where(r[np.arange(len(r)), lag] >= least, RATE / lag, 0.0)


def display_pitch(x: np.ndarray) -> np.ndarray:
    """Pitch under a Hann window, lags of 40 to 266 and over 0.25; 0 where the level is under 0.015."""
    r = autocorrelation(x * np.hanning(x.shape[1]))
    lag = r[:, 40:267].argmax(1) + 40
    loud = np.sqrt((x * x).mean(1)) >= 0.015
    return np.where(loud & (r[np.arange(len(r)), lag] > 0.25), RATE / lag, 0.0)


def dip_pitch(x: np.ndarray, good: float = 0.20, worst: float = 0.85) -> np.ndarray:
    """Pitch by the cumulative mean normalised difference: Hz of the bottom of the first dip under good, else of the lowest point if that is under worst, else 0.

    Lags are those of 60 to 400 Hz, half the row's length at most; rows are CONTEXT samples or fewer.
    """
    x = x[:, :CONTEXT]
    n = x.shape[1]
    low, high = RATE // 400, min(RATE // 60, n // 2)
    if low >= high or not len(x):
        return np.zeros(len(x))
    r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2)[:, : high + 1]
    difference, lag = 2 * (r[:, :1] - r[:, 1:]), np.arange(1, high + 1)
    curve = (difference * lag / (np.cumsum(difference, 1) + TINY))[:, : high - 1]  # of lags 1 to high - 1
    rises = np.ones(curve.shape, bool)  # where the next lag is no lower, or there is none
    rises[:, :-1] = curve[:, 1:] >= curve[:, :-1]
    place = np.arange(1, high)
    under = (curve < good) & (place >= low)
    first = under.argmax(1)
    bottom = (rises & (np.arange(high - 1) >= first[:, None])).argmax(1)
    lowest = curve[:, low - 1 :].argmin(1) + low - 1
    at = np.where(under.any(1), bottom, lowest)
    return np.where(under.any(1) | (curve[np.arange(len(x)), at] < worst), RATE / place[at], 0.0)


def flatness(magnitude: np.ndarray) -> np.ndarray:
    """Geometric over arithmetic mean of each row of magnitudes."""
    m = magnitude + TINY
    return np.exp(np.log(m).mean(1)) / m.mean(1)


def band_flatness(magnitude: np.ndarray) -> np.ndarray:
    """Of the bins of the voice's band; the sums have a floor of their own."""
    m = magnitude + TINY
    return (np.exp(np.log(m + TINY).mean(1)) / (m.mean(1) + TINY)).clip(0, 1)


def rolloff(power: np.ndarray, part: float = 0.85) -> np.ndarray:
    """Hz below which that part of the power lies."""
    whole = np.cumsum(power, 1)
    at = (whole < part * (whole[:, -1:] + TINY)).sum(1)
    return np.minimum(at, power.shape[1] - 1) * RATE / (2.0 * (power.shape[1] - 1))


def frame_features(x: np.ndarray) -> pd.DataFrame:
    """FEATURES of each row of a (frames, FRAME) matrix."""
    x = np.asarray(x, float)
    magnitude = magnitudes(x)
    power, f = magnitude**2, np.fft.rfftfreq(x.shape[1], 1 / RATE)
    total = power.sum(1) + TINY
    voice, speech = (f >= 80) & (f <= 3400), (f >= 200) & (f <= 3400)
    r = autocorrelation(x)
    raised = (magnitude + TINY) ** 2  # the fallback detector's spectrum has a floor
    small = cepstrum(power, SMALL_MEL, range(1, 3))
    return pd.DataFrame(
        {
            "rms": np.sqrt((x * x).mean(1)),
            "band_ratio": power[:, voice].sum(1) / total,
            "speech_ratio": raised[:, speech].sum(1) / (raised.sum(1) + TINY),
            "peak_ratio": raised[:, speech].max(1) / (raised[:, speech].sum(1) + TINY),
            "flatness": band_flatness(magnitude[:, voice]),
            "full_flatness": flatness(magnitude),
            "hnr_db": harmonicity(r),
            "f0_hz": pitch(r),
            "centroid": (power * f).sum(1) / total,
            "rolloff": rolloff(power),
            "zcr": np.abs(np.diff(np.sign(x), axis=1)).mean(1) / 2,
            "mfcc1": small[:, 0],
            "mfcc2": small[:, 1],
        }
    )


def _contexts(samples: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which starts, their rows of CONTEXT samples or of what is left, equally long in a row group)."""
    left = np.clip(len(samples) - starts, 0, CONTEXT)
    groups = []
    for n in np.unique(left):
        which = np.flatnonzero(left == n)
        groups.append((which, samples[starts[which, None] + np.arange(n)]))
    return groups


def context_pitch(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """dip_pitch of the CONTEXT samples from each start on, or of those that are left."""
    out = np.zeros(len(starts))
    for which, x in _contexts(samples, starts):
        out[which] = dip_pitch(x)
    return out


def segment_vector(samples: np.ndarray) -> np.ndarray:
    """The 31 numbers that describe a segment: 13 mean cepstral coefficients, their 13 mean differences, pitch, centroid, crossings, rolloff, flatness.

    A frame's pitch is the mean of those at its start and half a frame later, or the one that there is; the
    segment's is the median over frames that have one. Rolloff is the first frame's. Zeros if there is no whole frame.
    """
    n = len(samples) // FRAME
    if not n:
        return np.zeros(31)
    samples = np.asarray(samples, float)
    x = samples[: n * FRAME].reshape(n, FRAME)
    magnitude = magnitudes(x)
    power, f = magnitude**2, np.fft.rfftfreq(FRAME, 1 / RATE)
    c = cepstrum(power, SEGMENT_MEL, range(13))
    starts = np.arange(n) * FRAME
    one, two = context_pitch(samples, starts), context_pitch(samples, starts + FRAME // 2)
    f0 = np.where((one > 0) & (two > 0), (one + two) / 2, np.maximum(one, two))
    change = (c[-1] - c[0]) / (n - 1) if n > 1 else np.zeros(13)
    centroid = ((power * f).sum(1) / (power.sum(1) + TINY)).mean()
    crossings = (np.abs(np.diff(np.sign(x), axis=1)).mean(1) / 2).mean()
    return np.concatenate([c.mean(0), change, [np.median(f0[f0 > 0]) if (f0 > 0).any() else 0.0, centroid, crossings, rolloff(power[:1])[0], flatness(magnitude).mean()]])


def voice_streams(samples: np.ndarray, hop: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """(80 bins of pitch in [60, 400] Hz, smoothed over 13 bins and of length 1; variances of ten cepstral coefficients) of a recording's loud frames.

    Loud: at least 0.012 and the 15th percentile of the levels over 0.005, if there are ten. Without
    frames: zeros, and ones.
    """
    samples = np.asarray(samples, float)
    n = (len(samples) - FRAME) // hop
    if n < 2:
        return np.zeros(80), np.ones(10)
    starts = np.arange(n) * hop
    x = samples[starts[:, None] + np.arange(FRAME)]
    rms = np.sqrt((x * x).mean(1))
    heard = rms[rms > 0.005]
    loud = rms >= max(0.012, np.percentile(heard, 15) if len(heard) >= 10 else 0.012)
    if not loud.any():
        return np.zeros(80), np.ones(10)
    f0 = context_pitch(samples, starts[loud])
    c = cepstrum((magnitudes(x[loud]) + TINY) ** 2, VOICE_MEL, range(20)).astype(np.float32)
    return pitch_histogram(f0[f0 > 0]), c[:, 2:12].var(0) + 1e-8


def pitch_histogram(f0: np.ndarray, bins: int = 80, low: float = 60, high: float = 400, sigma: float = 2.0) -> np.ndarray:
    """Counts by bin, the last one closed, under a Gaussian of 2 * 3 sigma + 1 taps, over their Euclidean length if that isn't nearly zero."""
    counts = np.histogram(f0, bins, (low, high))[0].astype(float)
    reach = int(3 * sigma)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(counts, taps / taps.sum(), "same")
    length = np.linalg.norm(smooth)
    return smooth / length if length > 1e-8 else smooth


def combs(magnitude: np.ndarray, candidates: np.ndarray | None = None, harmonics: int = 6, factor: float = 3.0, score: float = 0.08, matched: int = 4, apart: float = 15.0) -> list[tuple[float, float, int]]:
    """(f0, score, harmonics) of harmonic combs in one spectrum, strongest first, none within ``apart`` Hz of a stronger one that stays."""
    return comb_rows(magnitude[None], candidates, harmonics, factor, score, matched, apart)[0]


def comb_rows(magnitude: np.ndarray, candidates: np.ndarray | None = None, harmonics: int = 6, factor: float = 3.0, score: float = 0.08, matched: int = 4, apart: float = 15.0) -> list[list[tuple[float, float, int]]]:
    """combs of each row of spectra: all rows and candidates in one pass for each harmonic; only candidates that are found are looked at one by one."""
    candidates = np.arange(80.0, 400.0, 5.0) if candidates is None else np.asarray(candidates, float)
    rows, bins = magnitude.shape
    width = RATE / (2 * (bins - 1))
    limit, total = factor * np.median(magnitude, axis=1)[:, None], (magnitude**2).sum(1)[:, None] + TINY
    around = magnitude.copy()  # the largest of the five bins around each
    for d in (1, 2):
        around[:, d:] = np.maximum(around[:, d:], magnitude[:, :-d])
        around[:, :-d] = np.maximum(around[:, :-d], magnitude[:, d:])
    energy, n = np.zeros((rows, len(candidates))), np.zeros((rows, len(candidates)), int)
    for h in range(1, harmonics + 1):
        centre = np.rint(candidates * h / width).astype(int)
        peaks = around[:, np.minimum(centre, bins - 1)]
        strong = (peaks > limit) & (centre < bins)
        energy += np.where(strong, peaks**2, 0.0)
        n += strong
    value = energy / total
    found: list[list[tuple[float, float, int]]] = [[] for _ in range(rows)]
    i, j = np.nonzero((value >= score) & (n >= matched))
    for row, c in zip(i.tolist(), zip(candidates[j].tolist(), value[i, j].tolist(), n[i, j].tolist())):
        found[row].append(c)
    return [_apart(row, apart) for row in found]


def _apart(found: list[tuple[float, float, int]], apart: float) -> list[tuple[float, float, int]]:
    kept: list[tuple[float, float, int]] = []
    for c in sorted(found, key=lambda c: (-c[1], c[0])):
        if all(abs(c[0] - k[0]) >= apart for k in kept):
            kept.append(c)
    return kept


def with_features(frames: DataFrame, keys: list[str], with_combs: bool = False, display: bool = False) -> DataFrame:
    """keys and FEATURES for each row of frames (samples: array of FRAME floats), and combs (strongest first) and display_hz (display_pitch) if asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole[start : start + ROWS]
                x = np.stack(batch["samples"].to_numpy())
                out = pd.concat([batch[keys].reset_index(drop=True), frame_features(x)], axis=1)
                if with_combs:
                    out["combs"] = [[{"f0_hz": a, "score": b, "n_harmonics": c} for a, b, c in row] for row in comb_rows(magnitudes(x.astype(float)))]
                if display:
                    out["display_hz"] = display_pitch(x.astype(float))
                yield out

    kinds = ", ".join([*(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} double" for c in FEATURES)])
    kinds += ", combs array<struct<f0_hz: double, score: double, n_harmonics: int>>" * with_combs + ", display_hz double" * display
    return frames.select(*keys, "samples").mapInPandas(run, kinds)


def as_lists(matrix: np.ndarray) -> pa.ListArray:
    """An array of each row's items."""
    rows, n = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(n)), pa.array(np.ascontiguousarray(matrix).ravel()))


def as_matrix(column: pa.Array) -> np.ndarray:
    """(rows, items) of an array of lists, which must be equally long; null items are NaN."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("rows differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lengths), int(lengths[0]) if len(lengths) else 0)


def with_spectra(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys and magnitude (of the bins from 0 to half the rate) for each row of frames (samples: array of FRAME floats). ROWS frames at once are in memory beside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], as_lists(magnitudes(as_matrix(part.column("samples"))))], names=[*keys, "magnitude"])

    return frames.select(*keys, "samples").mapInArrow(run, StructType([*[frames.schema[k] for k in keys], StructField("magnitude", ArrayType(DoubleType()))]))


def _by_row(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(part of a batch, the samples of each of its rows): views of the batch, not copies."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            lists = part.column("samples")
            yield part, [lists[i].values.to_numpy(zero_copy_only=False) for i in range(part.num_rows)]


def with_vectors(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys and features (segment_vector) for each row of segments (samples: array of floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, samples in _by_row(batches, ROWS):
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], as_lists(np.stack([segment_vector(s) for s in samples]))], names=[*keys, "features"])

    return segments.select(*keys, "samples").mapInArrow(run, StructType([*[segments.schema[k] for k in keys], StructField("features", ArrayType(DoubleType()))]))


def with_streams(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f0_vec and var_vec (voice_streams) for each row of recordings (samples: array of floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, samples in _by_row(batches, ROWS):
            f0, spread = zip(*(voice_streams(s) for s in samples))
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], as_lists(np.stack(f0).astype(float)), as_lists(np.stack(spread).astype(float))], names=[*keys, "f0_vec", "var_vec"])

    made = [StructField(c, ArrayType(DoubleType())) for c in ("f0_vec", "var_vec")]
    return recordings.select(*keys, "samples").mapInArrow(run, StructType([*[recordings.schema[k] for k in keys], *made]))
