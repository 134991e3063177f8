"""Sequential folds over a key's rows in order: constant or bounded state, time in proportion to rows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import joins, scans
from cadenza.operators.streamed import in_order

# Fixed values of the fallback speech score: a level under 2 floors is silence; noise, a narrow band and a single tone are none.
FLAT, NARROW, TONE = 0.65, 0.08, 0.55


def percentile(values: list[float], p: float) -> float:
    """Linear interpolation between the two nearest of the sorted values."""
    values = sorted(values)
    at = (len(values) - 1) * p
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


class NoiseFloor:
    """start until ``calibrate`` values are seen, then their percentile, then an average that non-speech moves."""

    def __init__(self, calibrate: int = 93, p: float = 0.2, alpha: float = 0.002, start: float = 0.005, least: float = 1e-5):
        self.calibrate, self.p, self.alpha, self.least = calibrate, p, alpha, least
        self.seen: list[float] | None = []
        self.level = start

    def push(self, value: float, speech: bool) -> float:
        if self.seen is not None:
            self.seen.append(value)
            if len(self.seen) >= self.calibrate:
                self.level, self.seen = max(percentile(self.seen, self.p), self.least), None
        elif not speech:
            self.level = max(self.least, self.level * (1 - self.alpha) + value * self.alpha)
        return self.level


def noise_floor(df: DataFrame, keys: list[str], order: list[str], value: str, speech: str, **limits: float) -> DataFrame:
    """keys, order, floor: the noise floor after each row. limits: those of NoiseFloor. A null value leaves the floor as it is, null speech is none."""
    program = scans.Floor(partial(NoiseFloor, **limits))
    return scans.scanned(df.withColumn(value, F.col(value).cast("double")), keys, order, [value, speech], {"floor": "double"}, program)


def fallback_score(rms: float, flatness: float, band: float, peak: float, floor: float) -> float:
    """Of speech, in [0, 1]: level over the noise floor, tonality and share of the band, unless one of them rules speech out."""
    if rms < 2 * floor or flatness > FLAT or band < NARROW or peak > TONE:
        return 0.0
    return 0.45 * min(1.0, rms / (4 * floor + 1e-10)) + 0.30 * max(0.0, 1 - flatness / FLAT) + 0.25 * min(1.0, band / 0.45)


def fallback_activity(df: DataFrame, keys: list[str], order: list[str], rms: str = "rms", flatness: str = "full_flatness", band: str = "speech_ratio", peak: str = "peak_ratio", threshold: float = 0.45, onset: int = 3, offset: int = 10, **limits: float) -> DataFrame:
    """keys, order, speech_prob, is_speech, floor for each row: the score looks at the floor, which speech holds still.

    Speech begins with the onset-th row in a row at the threshold and ends with the offset-th under it.
    """

    def fresh() -> Callable:
        floor, loud, quiet, on = NoiseFloor(**limits), 0, 0, False

        def push(level: float, flat: float, ratio: float, tone: float) -> tuple:
            nonlocal loud, quiet, on
            score = fallback_score(level, flat, ratio, tone, floor.level)
            loud, quiet = (loud + 1, 0) if score >= threshold else (0, quiet + 1)
            on = loud >= onset or on and quiet < offset
            return score, on, floor.push(level, on)

        return push

    return in_order(df, keys, order, [rms, flatness, band, peak], {"speech_prob": "double", "is_speech": "boolean", "floor": "double"}, fresh)


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str = "ema") -> DataFrame:
    """The last exponential moving average of each key; starts at the first value.

    The average is a weighted sum, whose weights follow from each row's place from the end: partial sums, no fold.
    """
    w = Window.partitionBy(*keys)
    last = F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))
    weight = F.pow(F.lit(1 - alpha), last - 1) * F.when(last == F.count(F.lit(1)).over(w), 1.0).otherwise(alpha)
    return df.select(*keys, (F.col(value) * weight).alias("_part")).groupBy(*keys).agg(F.sum("_part").alias(out))


def cooldown(df: DataFrame, keys: list[str], index: str, spacing: int) -> DataFrame:
    """keys, index of the rows that fire: each at least ``spacing`` after the one that fired before it. A null index doesn't fire."""
    return scans.scanned(df, keys, [index], [index], {}, scans.Cooldown(spacing))


def hysteresis(df: DataFrame, keys: list[str], order: list[str], flag: str, onset: int = 3, offset: int = 10, out: str = "active", pass_on: tuple[str, ...] = ()) -> DataFrame:
    """keys, order, pass_on and ``out``: as islands.hysteresis, where one key may have most of the rows."""
    return scans.scanned(df, keys, order, [flag], {out: "boolean"}, scans.Hysteresis(onset, offset), pass_on)


def greedy_apart(df: DataFrame, keys: list[str], position: str, strength: str, distance: float) -> DataFrame:
    """keys, position, strength of what stays when the strongest go first (ties: the smallest position) and drop all within ``distance`` of what stays."""

    def fresh() -> Callable:
        kept: list = []

        def push(at: float) -> tuple | None:
            i = bisect_left(kept, at)
            if i < len(kept) and kept[i] - at < distance or i and at - kept[i - 1] < distance:
                return None
            insort(kept, at)
            return ()

        return push

    return in_order(df, keys, [strength, position], [position], {}, fresh, descending=(strength,)).select(*keys, position, strength)


def merge_segments(segments: DataFrame, keys: list[str], start: str, end: str, level: str, floor: str, gap: float = 0.150, pad: float = 0.080, step: float = 0.032) -> DataFrame:
    """keys, start, end, level, n, is_whisper: segments less than gap apart joined, then widened by pad (not below 0).

    A joined level is the mean by lengths in steps (rounded, one at least), taken as the segment grows. A
    whisper has a level under five of its key's last noise floors. Which segments are joined is a scan over
    the key; levels are folded for each joined segment on its own. Segments without a start or an end go.
    """

    def fresh() -> Callable:
        held: list = []
        steps = lambda a, b: max(1, round((b - a) / step))

        def push(a: float, b: float, x: float) -> tuple:
            if held and a - held[1] < gap:
                n, m = steps(held[0], held[1]), steps(a, b)
                held[:] = [held[0], b, (held[2] * n + x * m) / (n + m), held[3], held[4] + 1]
            else:
                held[:] = [a, b, x, held[3] + 1 if held else 0, 1]
            return tuple(held)

        return push

    made = {"_a": "double", "_b": "double", "_level": "double", "_segment": "long", "n": "long"}
    grouped = scans.scanned(segments, keys, [start], [start, end], {"_group": "long"}, scans.Groups(gap), (end, level, floor))
    grown = in_order(grouped, [*keys, "_group"], [start], [start, end, level], made, fresh)
    last = segments.groupBy(*keys).agg(F.max_by(floor, start).alias("_floor"))
    whole = grown.groupBy(*keys, "_group").agg(F.max_by(F.struct("_a", "_b", "_level", "n"), "n").alias("s"))
    whole = joins.null_safe(whole, last, keys).withColumn("s", F.struct("s.*", "_floor"))
    return whole.select(*keys, F.greatest(F.lit(0.0), F.col("s._a") - pad).alias(start), (F.col("s._b") + pad).alias(end), F.col("s._level").alias(level), F.col("s.n").alias("n"), (F.col("s._level") < 5 * F.col("s._floor")).alias("is_whisper"))
