"""Named queries of whole stages: from waves to flags, reports, and plots of a fixed width. Events play the part of signals, as in catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import detection, reports
from cadenza.plans.catalogue import ACTIVE, FRAMES, K, SEGMENTS, W, active, frames, vad_segments
from cadenza.plans.voices import ORACLES as VOICES
from cadenza.plans.voices import merged_flags, wave_frames

#: Limits for waves of a few frames.
SMALL = {"enrol": 6, "silence": 2, "least": 2, "least_pitched": 1, "least_sustained": 2, "least_seconds": 0.06}
PIXELS = 12


def detected_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Features, gate, confidence of two voices, distance from the enrolled one and flags of each frame; pytest holds the chain against a plain loop."""
    found, _ = detection.detect(wave_frames(spark, sf), K, "frame_idx", **SMALL)
    return found.select("user_id", "frame_idx", "score", "is_voice", *[F.round(c, 5).alias(c) for c in ("rms", "f0_hz", "display_hz", "centroid", "a_confidence", "z")], "flagged")


def detected_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the flags of detected_frames."""
    return reports.flag_report(detection.detect(wave_frames(spark, sf), K, "frame_idx", **SMALL)[1], K)


def plot_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """What a plot of PIXELS columns shows of each user's levels and states."""
    shown = {"value": F.col("value"), "active": F.col("active").cast("int")}
    return detection.decimated(active(spark, sf), K, "idx", shown, PIXELS)


def activity_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report of each user's speech: sums, segments, changes, and a bar for each 10 frames."""
    return reports.activity_report(active(spark, sf).withColumn("level", F.col("value") / 1000), vad_segments(spark, sf), K, "idx", "active", "level", 1.0, 10)


def flag_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report of each user's merged flags."""
    return reports.flag_report(merged_flags(spark, sf), K)


QUERIES = {f.__name__: f for f in (detected_frames, detected_flags, plot_ranges, activity_report, flag_report)}

ORACLES = {
    "plot_ranges": f"""WITH {FRAMES}, {ACTIVE}, s AS (SELECT user_id, min(idx) AS low, max(idx) - min(idx) + 1 AS span FROM act GROUP BY user_id)
        SELECT user_id, ((idx - low) * {PIXELS}) // span AS pixel, min(idx) AS first_index, max(idx) AS last_index, count(*) AS n, min(value) AS value_min, max(value) AS value_max, min(active::INT) AS active_min, max(active::INT) AS active_max
        FROM act JOIN s USING (user_id) GROUP BY user_id, ((idx - low) * {PIXELS}) // span""",
    "activity_report": f"""WITH {FRAMES}, {ACTIVE}, {SEGMENTS},
        u AS (SELECT *, w - sp AS si FROM (SELECT user_id, count(*)::DOUBLE AS w FROM act GROUP BY user_id) LEFT JOIN (SELECT user_id, sum(end_s - start_s) AS sp0, count(*) AS n0 FROM seg GROUP BY user_id) USING (user_id), LATERAL (SELECT coalesce(sp0, 0)::DOUBLE AS sp, coalesce(n0, 0) AS n)),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_s, end_s) AS rank FROM seg),
        t AS (SELECT *, lag(active) OVER {W} AS was FROM act),
        p AS (SELECT user_id, idx // 10 AS part, 100.0::DOUBLE * count(*) FILTER (WHERE active) / count(*) AS sh, avg(value / 1000) AS lv FROM act GROUP BY user_id, idx // 10)
        SELECT user_id, 1 AS section, 1::BIGINT AS line, printf('duration %.2f s', w + 1e-9) AS text FROM u
        UNION ALL SELECT user_id, 1, 2, printf('speech %.2f s (%.1f %%)', sp + 1e-9, 100 * sp / greatest(w, 1) + 1e-9) FROM u
        UNION ALL SELECT user_id, 1, 3, printf('silence %.2f s (%.1f %%)', si + 1e-9, 100 * si / greatest(w, 1) + 1e-9) FROM u
        UNION ALL SELECT user_id, 1, 4, printf('segments %d', n) FROM u
        UNION ALL SELECT user_id, 2, rank, printf('%4d %9.2f s %9.2f s %9.2f s', rank, start_s + 1e-9, end_s + 1e-9, end_s - start_s + 1e-9) FROM r
        UNION ALL SELECT user_id, 3, idx, printf('%9.2f s %-7s %9.5f', idx + 1e-9, CASE WHEN active THEN 'SPEECH' ELSE 'SILENCE' END, value / 1000 + 1e-9) FROM t WHERE was IS DISTINCT FROM active
        UNION ALL SELECT user_id, 4, part, printf('%5d %6.0f %% %9.5f ', part, sh + 1e-9, lv + 1e-9) || rpad(repeat('#', floor(sh / 5 + 1e-9)::INT), 20, '.') FROM p""",
    "flag_report": f"""WITH m AS ({VOICES["merged_flags"]}),
        u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE severity = 'HIGH') AS h, count(*) FILTER (WHERE severity = 'MEDIUM') AS d, count(*) FILTER (WHERE scenario = 'A') AS a, count(*) FILTER (WHERE scenario = 'B') AS b, count(*) FILTER (WHERE scenario = 'AB') AS ab, sum(end_s - start_s) AS s FROM m GROUP BY user_id)
        SELECT user_id, 1 AS section, 1::BIGINT AS line, printf('flags %d, HIGH %d, MEDIUM %d', n, h, d) AS text FROM u
        UNION ALL SELECT user_id, 1, 2, printf('at once %d, changed voice %d, both %d', a, b, ab) FROM u
        UNION ALL SELECT user_id, 1, 3, printf('flagged %.2f s', s + 1e-9) FROM u
        UNION ALL SELECT user_id, 2, rank, printf('%4d %-2s %9.2f s %9.2f s %6.3f %-6s %s', rank, scenario, start_s + 1e-9, end_s + 1e-9, confidence + 1e-9, severity, kind) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_s, end_s) AS rank FROM m)""",
}
