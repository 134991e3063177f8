"""From frames of audio to flags of several speakers in one call: features, gate, combs, turns, merge.

Defined results: a frame without a key's index or without samples goes, of several frames of one index one
stays; null keys are one key. A key without voiced frames has no flags; one that isn't enrolled has no turns
to compare. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.operators import islands, joins, rolling, rules, turns
from cadenza.operators.tables import written

#: Seconds of a frame; frames that a confidence is averaged over; frames of a sustained flag; the least confidence and seconds of a flag; seconds between flags that are one.
STEP, SMOOTH, SUSTAINED, CONFIDENT, SECONDS, TOLERANCE = 0.032, 5, 47, 0.75, 1.5, 0.5


def gated(features: DataFrame, keys: list[str], index: str) -> DataFrame:
    """features with score (checks of a voice that a frame passes), is_voice, and a_confidence: that two voices speak at once, averaged over the last voiced frames; 0 where there is no voice."""
    checked = rolling.cv_gate(features, keys, [index], "rms")
    score = rules.voice_checks(F.col("band_ratio"), F.col("hnr_db"), F.col("flatness"), F.col("passed"))
    scored = checked.withColumn("score", score).withColumn("is_voice", F.col("score") >= 2).withColumn("_own", rules.comb_confidence(F.col("combs")))
    return rolling.moving_average(scored, [*keys, "is_voice"], [index], "_own", SMOOTH, "_mean").withColumn("a_confidence", rules.routed(F.col("is_voice"), F.col("_mean"))).drop("cv", "passed", "_own", "_mean")


def sustained(frames: DataFrame, keys: list[str], index: str, least: int = SUSTAINED, confidence: float = CONFIDENT) -> DataFrame:
    """keys, start_frame, end_frame (exclusive), confidence: runs of at least so many voiced frames, one after another but for silence, that are sure of two voices."""
    voiced = frames.where("is_voice").withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(index)))
    runs = islands.islands(voiced, keys, "_rank", F.col("a_confidence") >= confidence).groupBy(*keys, "island")
    found = runs.agg(F.min(index).alias("start_frame"), (F.max(index) + 1).alias("end_frame"), F.count(F.lit(1)).alias("_n"), F.max("a_confidence").alias("confidence"))
    return found.where(F.col("_n") >= least).drop("island", "_n")


def merged_flags(flags: DataFrame, keys: list[str], least_seconds: float = SECONDS, confidence: float = CONFIDENT, tolerance: float = TOLERANCE) -> DataFrame:
    """keys, start_s, end_s, scenario, kind, confidence, severity: long and sure flags (keys, start_s, end_s, scenario A or B, confidence), those that overlap or nearly do as one."""
    strong = flags.where((F.col("end_s") - F.col("start_s") >= least_seconds) & (F.col("confidence") >= confidence))
    aggs = {"_n": F.count(F.lit(1)), "_first": F.min("scenario"), "_last": F.max("scenario"), "confidence": F.max("confidence")}
    one = islands.merge_intervals(strong, keys, "start_s", "end_s", tolerance, aggs)
    kind = F.when(F.col("_n") > 1, "MULTIPLE_SPEAKERS_DETECTED").when(F.col("_first") == "A", "MULTIPLE_SPEAKERS_SIMULTANEOUS").otherwise("POSSIBLE_VOICE_CHANGE")
    scenario = F.when(F.col("_first") != F.col("_last"), "AB").otherwise(F.col("_first"))
    return one.select(*keys, "start_s", "end_s", scenario.alias("scenario"), kind.alias("kind"), "confidence", rules.severity(F.col("confidence")).alias("severity"))


def detect(frames: DataFrame, keys: list[str], index: str, step: float = STEP, enrol: int = turns.ENROL, silence: int = turns.SILENCE, least: int = turns.LEAST, least_pitched: int = turns.PITCHED, least_sustained: int = SUSTAINED, least_seconds: float = SECONDS, confidence: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """(frame table, flags) of frames (keys, index, samples: arrays of kernels.FRAME floats).

    Frame table: keys, index, rms, f0_hz, display_hz, centroid, score, is_voice, a_confidence, z (from the voice
    that was enrolled, by the profile as it is in the frame's turn; 0 where it isn't compared) and flagged
    (the frame is within a merged flag). Flags: as merged_flags, with times from frame 0.

    Features are made in one pass and written, as are the compared turns, which frames and flags share.
    """
    whole = frames.where(F.col(index).isNotNull() & (F.size("samples") == kernels.FRAME))
    # samples are never shuffled: repeated frames go when they are features
    features = kernels.with_features(whole, [*keys, index], with_combs=True, display=True).dropDuplicates([*keys, index])
    table = written(gated(features, keys, index).drop("combs"))
    spoken = written(turns.voiced_turns(table.where("is_voice").select(*keys, index, "f0_hz", "centroid"), keys, index, enrol, silence))
    compared = written(turns.compare_turns(spoken, keys, index, enrol=enrol, least=least, least_pitched=least_pitched, flag=confidence))
    seconds = lambda c: (F.col(c) * step).cast("double")
    timed = lambda df, scenario: df.select(*keys, seconds("start_frame").alias("start_s"), seconds("end_frame").alias("end_s"), F.lit(scenario).alias("scenario"), "confidence")
    both = timed(sustained(table, keys, index, least_sustained, confidence), "A").unionByName(timed(compared.where("flagged"), "B"))
    flags = written(merged_flags(both, keys, least_seconds, confidence))
    distances = turns.frame_distances(spoken, compared, keys, index, least=least).select(*keys, index, "z")
    with_z = joins.null_safe(table, distances, [*keys, index], "left")
    held = joins.in_intervals(with_z.withColumn("_at", seconds(index)), flags, keys, "_at", "start_s", "end_s")
    shown = ["rms", "f0_hz", "display_hz", "centroid", "score", "is_voice", "a_confidence"]
    return held.select(*keys, index, *shown, F.coalesce("z", F.lit(0.0)).alias("z"), F.col("inside").alias("flagged")), flags


def decimated(df: DataFrame, keys: list[str], index: str, values: dict[str, Column], pixels: int) -> DataFrame:
    """keys, pixel, first_index, last_index, n and, of each value, name_min and name_max: what a plot of so many pixels shows, with every peak.

    A key's indexes from its first to its last are cut into at most ``pixels`` equal ranges; ranges without rows are left out. Rows
    without an index go; null values count for nothing. Both aggregates combine before they are shuffled, so a long key is no single task's.
    """
    rows = df.where(F.col(index).isNotNull()).select(*keys, F.col(index).cast("long").alias("_at"), *[c.alias(f"_value_{n}") for n, c in values.items()])
    spans = rows.groupBy(*keys).agg(F.min("_at").alias("_low"), (F.max("_at") - F.min("_at") + 1).alias("_span"))
    placed = joins.null_safe(rows, spans, keys).withColumn("pixel", F.expr(f"cast((cast(_at - _low as decimal(38, 0)) * {int(pixels)}) div _span as long)"))
    ends = [f(f"_value_{n}").alias(f"{n}_{end}") for n in values for end, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy(*keys, "pixel").agg(F.min("_at").alias("first_index"), F.max("_at").alias("last_index"), F.count(F.lit(1)).alias("n"), *ends)
