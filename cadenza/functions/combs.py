"""Harmonic combs of a spectrum, as columns: candidates, their harmonics and the bins around each, without a join or Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.kernels import RATE, TINY


def combs(magnitude: Column, low: int = 80, high: int = 395, step: int = 5, harmonics: int = 6, factor: float = 3.0, score: float = 0.08, matched: int = 4, apart: float = 15.0) -> Column:
    """Array of (f0_hz, score, n_harmonics), strongest first, none within ``apart`` Hz of a stronger one that stays: as kernels.combs of one spectrum.

    A harmonic counts if the largest of the five bins around it is over factor medians; a candidate, if
    enough of its harmonics do and their energy is a large enough share of all.
    """
    n = F.size(magnitude)
    ordered = F.sort_array(magnitude)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    energy = F.aggregate(magnitude, F.lit(0.0), lambda s, x: s + x * x) + TINY
    held = F.struct(magnitude.alias("m"), (middle * factor).alias("limit"), energy.alias("energy"), (F.lit(float(RATE)) / (2 * (n - 1))).alias("width"), n.alias("n"))

    def candidate(f0: Column, s: Column) -> Column:
        centres = F.filter(F.transform(F.sequence(F.lit(1), F.lit(harmonics)), lambda h: F.rint(f0 * h / s["width"]).cast("int")), lambda c: c < s["n"])
        first = lambda c: F.greatest(c - 2, F.lit(0))
        peaks = F.filter(F.transform(centres, lambda c: F.array_max(F.slice(s["m"], first(c) + 1, c + 3 - first(c)))), lambda p: p > s["limit"])
        return F.struct(f0.alias("f0_hz"), (F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p * p) / s["energy"]).alias("score"), F.size(peaks).alias("n_harmonics"))

    def found(s: Column) -> Column:
        every = F.transform(F.sequence(F.lit(low), F.lit(high), F.lit(step)), lambda f: candidate(f.cast("double"), s))
        good = F.filter(every, lambda c: (c["score"] >= score) & (c["n_harmonics"] >= matched))
        best = F.array_sort(good, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["f0_hz"] < b["f0_hz"], -1).when(a["f0_hz"] > b["f0_hz"], 1).otherwise(0))
        none = F.filter(best, lambda c: F.lit(False))
        return F.aggregate(best, none, lambda kept, c: F.when(F.exists(kept, lambda k: F.abs(k["f0_hz"] - c["f0_hz"]) < apart), kept).otherwise(F.array_append(kept, c)))

    # held is bound once for all candidates
    return F.get(F.transform(F.array(held), found), F.lit(0))
