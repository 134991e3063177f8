"""Turns of one voice against a reference profile that drifts with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import joins, rules
from cadenza.operators.islands import islands
from cadenza.operators.streamed import in_order

#: Voiced frames that make the profile, silent frames that end a turn, frames and pitched frames that a turn needs.
ENROL, SILENCE, LEAST, PITCHED = 60, 10, 15, 5
#: The least deviations of pitch and centroid; their weights in a distance.
F0_STD, CENTROID_STD, F0_WEIGHT, CENTROID_WEIGHT = 1.0, 10.0, 0.65, 0.35


def voiced_turns(voiced: DataFrame, keys: list[str], index: str, enrol: int = ENROL, silence: int = SILENCE) -> DataFrame:
    """voiced with turn: 0 for the first ``enrol`` rows of a key, then 1, 2, ...; a turn ends where ``silence`` indexes are missing."""
    ranked = voiced.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(index)))
    later = islands(ranked.where(F.col("_rank") > enrol), keys, index, F.lit(True), silence, "turn").withColumn("turn", F.col("turn").cast("long"))
    return ranked.where(F.col("_rank") <= enrol).withColumn("turn", F.lit(0).cast("long")).unionByName(later).drop("_rank")


def pitched(f0: Column) -> Column:
    """A pitch of 0 is none."""
    return F.when(f0 > 0, f0)


def reference_profile(turns: DataFrame, keys: list[str], f0: str = "f0_hz", centroid: str = "centroid", enrol: int = ENROL) -> DataFrame:
    """keys and the profile of turn 0: means, and population deviations with their least values; keys that are not fully enrolled or have no pitch have none."""
    p = pitched(F.col(f0))
    found = turns.where("turn = 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(p).alias("f0_mean"), F.greatest(F.stddev_pop(p), F.lit(F0_STD)).alias("f0_std"), F.avg(centroid).alias("centroid_mean"), F.greatest(F.stddev_pop(centroid), F.lit(CENTROID_STD)).alias("centroid_std")
    )
    return found.where((F.col("_n") >= enrol) & F.col("f0_mean").isNotNull()).drop("_n")


def compare_turns(turns: DataFrame, keys: list[str], index: str, f0: str = "f0_hz", centroid: str = "centroid", enrol: int = ENROL, least: int = LEAST, least_pitched: int = PITCHED, flag: float = 0.75, still: float = 2.0, drift: float = 0.05) -> DataFrame:
    """keys, turn, start_frame, end_frame (exclusive), n, f0, z, confidence, flagged, reference_f0, reference_centroid for each turn after the profile.

    A turn of enough frames, enough of them pitched, is compared with the profile as it is by then: its
    means' distances in deviations. If it isn't flagged and is near, the profile's means move towards it.
    Turns that are too short have a null z and leave the profile alone; reference columns are those before the turn.
    """
    p = pitched(F.col(f0))
    sums = turns.where("turn > 0").groupBy(*keys, "turn").agg(F.min(index).alias("start_frame"), (F.max(index) + 1).alias("end_frame"), F.count(F.lit(1)).alias("n"), F.count(p).alias("_pitched"), F.avg(p).alias("f0"), F.avg(centroid).alias("_centroid"))
    met = joins.null_safe(sums, reference_profile(turns, keys, f0, centroid, enrol), keys)

    def fresh() -> Callable:
        now: list[float] = []

        def push(n: int, with_pitch: int, mean_f0: float, mean_centroid: float, f0_mean: float, f0_std: float, centroid_mean: float, centroid_std: float) -> tuple:
            if not now:
                now[:] = f0_mean, centroid_mean
            before = tuple(now)
            if n < least or with_pitch < least_pitched:
                return None, *before
            z = F0_WEIGHT * abs(mean_f0 - now[0]) / f0_std + CENTROID_WEIGHT * abs(mean_centroid - now[1]) / centroid_std
            if rules.plain_z_confidence(z) < flag and z < still:
                now[:] = [(1 - drift) * now[0] + drift * mean_f0, (1 - drift) * now[1] + drift * mean_centroid]
            return z, *before

        return push

    inputs = ["n", "_pitched", "f0", "_centroid", "f0_mean", "f0_std", "centroid_mean", "centroid_std"]
    made = {"z": "double", "reference_f0": "double", "reference_centroid": "double"}
    found = in_order(met, keys, ["turn"], inputs, made, fresh, ("start_frame", "end_frame", "n", "f0", "f0_std", "centroid_std"))
    confidence = rules.z_confidence(F.col("z"))
    return found.withColumn("confidence", F.when(F.col("z").isNotNull(), confidence)).withColumn("flagged", F.coalesce(F.col("confidence") >= flag, F.lit(False)))


def frame_distances(turns: DataFrame, compared: DataFrame, keys: list[str], index: str, f0: str = "f0_hz", centroid: str = "centroid", least: int = LEAST) -> DataFrame:
    """keys, index, z and confidence of each voiced frame: 0 in the profile and in a turn's first frames, then its distance from the profile as it is by then.

    A frame without pitch has no distance in pitch.
    """
    place = F.row_number().over(Window.partitionBy(*keys, "turn").orderBy(index))
    met = joins.null_safe(turns.withColumn("_place", place), compared.select(*keys, "turn", "reference_f0", "reference_centroid", "f0_std", "centroid_std"), [*keys, "turn"], "left")
    apart_f0 = F.when(F.col(f0) > 0, F.abs(F.col(f0) - F.col("reference_f0")) / F.col("f0_std")).otherwise(0.0)
    z = F0_WEIGHT * apart_f0 + CENTROID_WEIGHT * F.abs(F.col(centroid) - F.col("reference_centroid")) / F.col("centroid_std")
    z = F.when((F.col("turn") > 0) & (F.col("_place") >= least), F.coalesce(z, F.lit(0.0))).otherwise(0.0)
    return met.select(*keys, index, z.alias("z")).withColumn("confidence", rules.z_confidence(F.col("z")))
