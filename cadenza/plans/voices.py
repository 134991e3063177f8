"""Named queries of the audio half: features, gates, turns, verification, chunks. Events play the part of signals, as in catalogue.

``waves`` gives each user one frame of 512 samples: four tones whose pitches and strengths are those of the
user's first events, and a little noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cadenza.functions import combs, kernels
from cadenza.operators import folds, histograms, islands, joins, rolling, rules, tables, turns, vectors
from cadenza.plans.catalogue import ACTIVE, COS, FRAMES, K, SEGMENTS, W, ZCONF, active, frames, table, vad_segments
from cadenza.sources import wav
from cadenza.streaming import session

#: Two pi, as both engines take it.
CIRCLE = 6.283185307179586


#: Samples that a task makes at once.
MADE = 1 << 18


def _sounded(tones: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys and samples of each row's tones ``_t`` (idx, value); rows are dealt out before samples are made, by a number of parts: tones are
    small and samples are not, so parts aren't to be joined by the size of tones. A task makes and passes on MADE samples at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, rows = np.arange(n), max(1, MADE // n)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = np.empty((part.num_rows, n))
                for x, user, row in zip(out, part.column("user_id").to_pylist(), part.column("_t").to_pylist()):
                    x[:] = (((j * 7919 + user * 104729) % 1000) / 1000.0 - 0.5) * 0.02
                    for t in row:
                        x += np.sin(CIRCLE * (100 + t["value"]) * j / 16000.0) * (0.05 + 0.02 * (t["idx"] % 4))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], kernels.as_lists(out)], names=[*keys, "samples"])

    schema = StructType([*[tones.schema[k] for k in keys], StructField("samples", ArrayType(DoubleType()))])
    return tones.repartition(tables.parts(tones), *keys).mapInArrow(run, schema)


def waves(spark: SparkSession, sf: str, n: int = 512) -> DataFrame:
    """user_id, samples: of each user's first four events."""
    tones = frames(spark, sf).where("idx < 4").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_t"))
    return _sounded(tones, ["user_id"], n)


def wave_frames(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, frame_idx, samples: a frame for each four events of a user, in order; what is left over goes."""
    tones = frames(spark, sf).groupBy("user_id", F.floor(F.col("idx") / 4).alias("frame_idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_t"))
    return _sounded(tones.where(F.size("_t") == 4), ["user_id", "frame_idx"], 512)


def frame_kernels(spark: SparkSession, sf: str) -> DataFrame:
    made = kernels.with_features(waves(spark, sf), K)
    return made.select("user_id", *[F.round(c, 4).alias(c) for c in kernels.FEATURES])


def spectral_combs(spark: SparkSession, sf: str) -> DataFrame:
    """Harmonic combs of each user's wave, and what they say of two voices at once."""
    made = kernels.with_spectra(waves(spark, sf), K).withColumn("combs", combs.combs(F.col("magnitude")))
    strongest = F.get("combs", F.lit(0))
    return made.select("user_id", F.size("combs").cast("long").alias("n"), strongest["f0_hz"].alias("f0_hz"), F.round(strongest["score"], 7).alias("score"), strongest["n_harmonics"].cast("long").alias("n_harmonics"), F.round(rules.comb_confidence(F.col("combs")), 6).alias("confidence"))


def hysteresis_scan(spark: SparkSession, sf: str) -> DataFrame:
    """As hysteresis_state, by a scan whose long keys are many tasks' work."""
    return folds.hysteresis(frames(spark, sf).withColumn("loud", F.col("value") > 20), K, ["idx"], "loud", 3, 4).select("user_id", "idx", "active")


def speaker_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """How long speech overlaps with each speaker (type) of a user, who speaks from a frame on for as long as its level says."""
    speakers = frames(spark, sf).select("user_id", "event_type", F.col("idx").cast("double").alias("from_s"), (F.col("idx") + F.floor(F.col("value") / 8) + 1).cast("double").alias("to_s"))
    met = joins.overlaps(vad_segments(spark, sf), speakers, K, ("start_s", "end_s"), ("from_s", "to_s"))
    shared = F.least("end_s", "to_s") - F.greatest("start_s", "from_s")
    return met.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(shared).alias("seconds"))


def voice_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of each frame, and a detector's value for the voiced ones."""
    f = rolling.cv_gate(frames(spark, sf), K, ["idx"], "value")
    score = rules.voice_checks(F.col("value") % 1, F.col("value") / 10, (F.col("value") * 7) % 1, F.col("passed"))
    return f.withColumn("score", score).select("user_id", "idx", "score", (F.col("score") >= 2).alias("is_voice"), F.round(rules.routed(F.col("score") >= 2, F.col("value") / 100), 9).alias("confidence"))


def noise_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Voiced and other frames of each user."""
    return voice_gate(spark, sf).groupBy("user_id").agg(F.count_if("is_voice").alias("voice"), F.count_if(~F.col("is_voice")).alias("noise"), F.round(100.0 * F.count_if(~F.col("is_voice")) / F.greatest(F.count(F.lit(1)), F.lit(1)), 9).alias("noise_pct"))


def two_voices(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence that two voices speak, from combs: the values of a frame and the two before it, strongest first, without those under 15."""
    w = Window.partitionBy("user_id").orderBy("idx").rowsBetween(-2, 0)
    held = frames(spark, sf).select("user_id", "idx", F.sort_array(F.filter(F.collect_list("value").over(w), lambda x: x >= 15), asc=False).alias("v"))
    combs = F.transform("v", lambda x: F.struct(x.alias("score")))
    return held.select("user_id", "idx", F.round(rules.comb_confidence(combs), 9).alias("confidence"))


def flag_events(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of at least 3 frames of a high confidence: their highest and mean, the first frame that has the highest, how severe; only long or strong ones."""
    scored = frames(spark, sf).withColumn("confidence", F.col("value") / 100)
    runs = islands.islands(scored, K, "idx", F.col("confidence") >= 0.2).groupBy("user_id", "island")
    found = runs.agg(F.min("idx").alias("start_frame"), (F.max("idx") + 1).alias("end_frame"), F.max("confidence").alias("confidence_max"), F.avg("confidence").alias("confidence_avg"), F.max_by(F.col("idx"), F.struct("confidence", -F.col("idx"))).alias("best_frame"))
    kept = found.where((F.col("end_frame") - F.col("start_frame") >= 3) & (F.col("confidence_max") >= 0.75))
    return kept.select("user_id", "start_frame", "end_frame", F.round("confidence_max", 3).alias("confidence_max"), F.round("confidence_avg", 3).alias("confidence_avg"), "best_frame", rules.severity(F.col("confidence_max")).alias("severity"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Voiced frames with a pitch (none under 40) and a centroid."""
    f = frames(spark, sf).where("value > 25").select("user_id", "idx", F.when(F.col("value") >= 40, F.col("value")).otherwise(0.0).alias("f0_hz"), (F.col("value") * 3 + F.col("idx")).alias("centroid"))
    return turns.voiced_turns(f, K, "idx", 10, 2)


SMALL = {"enrol": 10, "least": 3}


def turn_comparison(spark: SparkSession, sf: str) -> DataFrame:
    found = turns.compare_turns(_turns(spark, sf), K, "idx", **SMALL, least_pitched=2)
    return found.select("user_id", "turn", "start_frame", "end_frame", "n", *[F.round(c, 9).alias(c) for c in ("f0", "z", "confidence", "reference_f0", "reference_centroid")], "flagged")


def frame_distance(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    found = turns.frame_distances(t, turns.compare_turns(t, K, "idx", **SMALL, least_pitched=2), K, "idx", least=3)
    return found.select("user_id", "idx", F.round("z", 6).alias("z"), F.round("confidence", 6).alias("confidence"))


def fallback_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Speech by level, tonality, band and noise floor, each of which looks at the others."""
    f = frames(spark, sf).select("user_id", "idx", (F.col("value") / 1000).alias("rms"), ((F.col("value") * 3) % 1).alias("full_flatness"), ((F.col("value") * 7) % 1).alias("speech_ratio"), ((F.col("value") * 11) % 1).alias("peak_ratio"))
    found = folds.fallback_activity(f, K, ["idx"], onset=2, offset=3, calibrate=10)
    return found.select("user_id", "idx", F.round("speech_prob", 7).alias("speech_prob"), "is_speech", F.round("floor", 9).alias("floor"))


def merged_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of at least 2 frames; those less than 4 apart are one, whose level is weighted by lengths as they grow; then widened."""
    # a segment is an island of active frames: its level needs no join
    held = islands.islands(active(spark, sf), K, "idx", F.col("active"))
    segments = held.groupBy("user_id", "island").agg(F.min("idx").cast("double").alias("start_s"), (F.max("idx") + 1).cast("double").alias("end_s"), F.avg("value").alias("rms")).where("end_s - start_s >= 2").withColumn("floor", F.lit(8.0))
    found = folds.merge_segments(segments, K, "start_s", "end_s", "rms", "floor", gap=4.0, pad=1.0, step=1.0)
    return found.select("user_id", "start_s", "end_s", F.round("rms", 7).alias("rms"), "n", "is_whisper")


def verified_voices(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as two streams: the vector, and the squares of its first ten numbers; label 0 is enrolled."""
    squares = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * x.cast("double") * 400)
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("f0_vec"), squares.alias("var_vec"))
    found = vectors.verified(e, e.where("label = 0"), "vec_id")
    return found.select("vec_id", "similarity", "sim_f0", "sim_var", "confidence", "verdict")


def smooth_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """80 bins of value in [60, 400] for each type, under a Gaussian, of length 1."""
    found = histograms.smoothed(table(spark, sf, "events"), ["event_type"], F.col("value"), 80, 60.0, 400.0, 2.0)
    return found.select("event_type", "bin", F.round("share", 7).alias("share"))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy(F.col("user_id").alias("recording_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("samples"))


def enrolment_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 20 samples, a last one of 8 or more too."""
    found = wav.chunks_of(_signals(spark, sf), 20 / wav.RATE, 8 / wav.RATE)
    return found.select(F.col("recording_id").alias("user_id"), F.col("chunk").cast("long").alias("chunk"), F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 7).alias("total"))


def rechunked_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of uneven lengths as whole frames of 16."""
    f = frames(spark, sf).groupBy(F.col("user_id").alias("recording_id"), F.floor(F.pow(F.col("idx"), 0.7)).alias("block_idx"))
    blocks = f.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("samples"))
    return wav.rechunked(blocks, 16).select(F.col("recording_id").alias("user_id"), "frame_idx", F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 7).alias("total"))


def speaker_audio(spark: SparkSession, sf: str) -> DataFrame:
    """A signal for each user and type: silent but for blocks of 4 samples that begin with an event of the type."""
    starts = frames(spark, sf).where("idx % 4 = 0").select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("speaker_id"), (F.col("idx") / 4).cast("int").alias("start_frame"), (F.col("idx") / 4 + 1).cast("int").alias("end_frame"))
    signals = _signals(spark, sf).select("recording_id", F.transform("samples", lambda x: x.cast("float")).alias("samples"))
    found = wav.speaker_recordings(signals, starts, 4)
    return found.select(F.col("recording_id").alias("user_id"), F.col("speaker_id").alias("event_type"), F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"))


def level_plot(spark: SparkSession, sf: str) -> DataFrame:
    """What a plot of levels shows: level, smoothed level, and how the level stands to the median of its user."""
    w = Window.partitionBy("user_id")
    smooth = rolling.centred_smooth(frames(spark, sf), K, ["idx"], "value")
    return smooth.select("user_id", "idx", "value", F.round("smooth", 7).alias("smooth"), (F.col("value") > F.median("value").over(w)).alias("over_median"))


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A report as numbered lines: a head, then a line for each user with segments."""
    s = vad_segments(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
    lines = s.select(F.col("user_id").alias("line"), F.format_string("user %d: %d segments, %.1f s", "user_id", "n", "seconds").alias("text"))
    return spark.createDataFrame([(-1, "SEGMENTS")], "line long, text string").unionByName(lines)


def merged_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Strong flags of two detectors, merged where they overlap: kind, scenario, severity, and the details of the first beside those of the last."""
    f = frames(spark, sf).where(F.col("event_type").isin("click", "purchase") & (F.col("value") >= 15))
    a = F.col("event_type") == "click"
    one = f.select(
        "user_id", F.col("idx").cast("double").alias("start_s"), (F.col("idx") + F.floor(F.col("value") / 40) + 1).cast("double").alias("end_s"), F.when(a, "A").otherwise("B").alias("scenario"), (F.col("value") / 100).alias("confidence"),
        F.when(a, "MULTIPLE_SPEAKERS_SIMULTANEOUS").otherwise("POSSIBLE_VOICE_CHANGE").alias("kind"), F.create_map(F.lit("z"), F.round("value", 2).cast("string")).alias("details"),
    )
    order = F.struct("start_s", "scenario")
    merged = islands.merge_intervals(
        one, K, "start_s", "end_s", 0.5,
        {"n": F.count("*"), "kinds": F.count_distinct("scenario"), "one": F.min("scenario"), "kind": F.min("kind"), "confidence": F.max("confidence"), "first": F.min_by("details", order), "last": F.max_by("details", order)},
    )
    several = F.col("n") > 1
    details = F.when(several, F.map_concat("first", F.create_map(F.lit("merged_with"), F.element_at("last", "z")))).otherwise(F.col("first"))
    return merged.select(
        "user_id", "start_s", "end_s", F.when(several, "MULTIPLE_SPEAKERS_DETECTED").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kinds") > 1, "AB").otherwise(F.col("one")).alias("scenario"), F.round("confidence", 9).alias("confidence"), rules.severity(F.col("confidence")).alias("severity"),
        F.element_at(details, "z").alias("z"), F.element_at(details, "merged_with").alias("merged_with"),
    )


def flagged_voices(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by how many are flagged (uncertain or no match) and how many are the enrolled voice (match or likely), by label."""
    found = verified_voices(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return found.groupBy("label").agg(F.count_if(F.col("verdict").isin("MISMATCH", "UNCERTAIN")).alias("flagged"), F.count_if(F.col("verdict").isin("MATCH", "LIKELY")).alias("enrolled"))


def silence_gate(spark: SparkSession, sf: str) -> DataFrame:
    """0.65 of the median of each user's values over 5 (0.02 where there are none), and how many frames are over it."""
    gated = rolling.percentile_threshold(frames(spark, sf), K, "value", 0.5, 5.0, 0.0, 1, default=0.02)
    return gated.groupBy("user_id").agg(F.round(F.max("gate") * 0.65, 9).alias("gate"), F.count_if(F.col("value") > F.col("gate") * 0.65).alias("voiced"))


def segment_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """31 numbers for each user's wave of 4096 samples; pytest holds them against a naive version."""
    made = kernels.with_vectors(waves(spark, sf, 4096), K)
    return made.select("user_id", F.transform("features", lambda x: F.round(x, 4)).alias("features"))


def voice_prints(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's wave of 4096 samples as two streams; pytest holds them against a naive version."""
    made = kernels.with_streams(waves(spark, sf, 4096), K)
    return made.select("user_id", F.transform("f0_vec", lambda x: F.round(x, 6)).alias("f0_vec"), F.transform("var_vec", lambda x: F.round(x, 4)).alias("var_vec"))


def live_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events and summaries of sessions: a chunk for each event, some with the vector of a voice; pytest holds the operator against an independent loop, in batch and as a stream.

    A chunk can name no vector beyond -99 to 101, so these few are broadcast: most chunks name none, and a shuffle by the vector
    would make them one task's. Vectors stay floats, half the bytes, while chunks are put in order.
    """
    voice = table(spark, sf, "embeddings").where(F.col("vec_id").between(-99, 101)).select(F.col("vec_id").alias("_vec"), "embedding")
    f = frames(spark, sf).withColumn("_vec", F.when(F.col("idx") % 5 == 0, F.col("idx") % 3 + F.col("user_id") % 100))
    chunks = f.join(F.broadcast(voice), "_vec", "left").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("idx").alias("chunk_idx"), (F.col("value") / 50).alias("speech_prob"), "embedding", F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "view", False).alias("lip_active"), F.when(F.col("idx") == 0, F.col("embedding")).alias("enrolled")
    )
    found = session.session_events_batch(chunks, summaries=True)
    return found.select("session_id", "chunk_idx", "event_type", "confidence", "verify_score", "n_speakers", "lip_active", "total_chunks_processed", "total_speech_s", "verify_score_mean", "verify_score_min", "enrolled")


QUERIES = {
    f.__name__: f
    for f in (
        frame_kernels, spectral_combs, hysteresis_scan, speaker_overlaps, voice_gate, noise_counts, two_voices, flag_events, turn_comparison, frame_distance, fallback_activity, merged_segments, verified_voices, smooth_histogram, enrolment_chunks, rechunked_blocks,
        speaker_audio, level_plot, report_lines, merged_flags, flagged_voices, silence_gate,
        segment_vectors, voice_prints, live_sessions,
    )
}

#: fr with the checks of voice_gate.
GATE = f"""{FRAMES}, g AS (SELECT user_id, idx, value, (value % 1 > 0.45)::INT + (value / 10 >= 6)::INT + ((value * 7) % 1 <= 0.35)::INT + (n < 12 OR cv BETWEEN 0.15 AND 2.5)::INT AS score
        FROM (SELECT *, stddev_pop(value) OVER w / (avg(value) OVER w + 1e-10) AS cv, count(*) OVER w AS n FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS 39 PRECEDING)))"""
#: Turns, the profile, and the comparison by recursion over turns; q is the state before a turn.
TURNS = f"""{FRAMES}, v0 AS (SELECT user_id, idx, CASE WHEN value >= 40 THEN value ELSE 0 END AS f0, value * 3 + idx AS cen, row_number() OVER {W} AS rank FROM fr WHERE value > 25),
        v AS (SELECT *, CASE WHEN rank <= 10 THEN 0 ELSE sum(new) OVER {W} END AS turn FROM (SELECT *, CASE WHEN rank <= 10 THEN 0 WHEN rank = 11 OR idx - lag(idx) OVER {W} > 2 THEN 1 ELSE 0 END AS new FROM v0)),
        p AS (SELECT user_id, avg(f0) FILTER (WHERE f0 > 0) AS fm, greatest(stddev_pop(f0) FILTER (WHERE f0 > 0), 1.0) AS fs, avg(cen) AS cm, greatest(stddev_pop(cen), 10.0) AS cs FROM v WHERE turn = 0 GROUP BY user_id HAVING count(*) >= 10 AND count(*) FILTER (WHERE f0 > 0) > 0),
        t AS (SELECT user_id, turn, min(idx) AS start_frame, max(idx) + 1 AS end_frame, count(*) AS n, count(*) FILTER (WHERE f0 > 0) AS pitched, avg(f0) FILTER (WHERE f0 > 0) AS f0, avg(cen) AS cen FROM v WHERE turn > 0 GROUP BY user_id, turn),
        q AS (
            SELECT t.user_id, t.turn, p.fm AS rf, p.cm AS rc FROM t JOIN p USING (user_id) WHERE turn = 1
            UNION ALL
            SELECT q.user_id, q.turn + 1, CASE WHEN z < 2 AND {ZCONF} < 0.75 THEN 0.95 * rf + 0.05 * f0 ELSE rf END, CASE WHEN z < 2 AND {ZCONF} < 0.75 THEN 0.95 * rc + 0.05 * cen ELSE rc END
            FROM (SELECT q.*, t.f0, t.cen, CASE WHEN t.n >= 3 AND t.pitched >= 2 THEN 0.65 * abs(t.f0 - rf) / p.fs + 0.35 * abs(t.cen - rc) / p.cs END AS z FROM q JOIN t ON t.user_id = q.user_id AND t.turn = q.turn JOIN p ON p.user_id = q.user_id) q
            WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = q.user_id AND t.turn = q.turn + 1)),
        c AS (SELECT t.*, rf, rc, fs, cs, CASE WHEN t.n >= 3 AND t.pitched >= 2 THEN 0.65 * abs(t.f0 - rf) / fs + 0.35 * abs(t.cen - rc) / cs END AS z FROM t JOIN q USING (user_id, turn) JOIN p USING (user_id))"""
SUM = "(SELECT sum(x) FROM (SELECT unnest({}) AS x))"
WAVES = f"""{FRAMES}, j AS (SELECT unnest(range(512)) AS j),
        s AS (SELECT user_id, j, ((j * 7919 + user_id * 104729) % 1000 / 1000.0::DOUBLE - 0.5::DOUBLE) * 0.02::DOUBLE + sum(sin({CIRCLE}::DOUBLE * (100 + value) * j / 16000.0::DOUBLE) * (0.05::DOUBLE + 0.02::DOUBLE * idx)) AS x FROM fr, j WHERE idx < 4 GROUP BY user_id, j),
        h AS (SELECT user_id, j, x * (0.5 - 0.5 * cos({CIRCLE} * j / 511)) AS x FROM s),
        m AS (SELECT user_id, k, k * 31.25 AS f, sqrt(sum(x * cos({CIRCLE} * ((j * k) % 512) / 512)) ** 2 + sum(x * sin({CIRCLE} * ((j * k) % 512) / 512)) ** 2) AS m FROM h, (SELECT unnest(range(257)) AS k) GROUP BY user_id, k),
        a AS (SELECT s.user_id, lag, sum(s.x * o.x) AS r FROM s, (SELECT unnest(range(32, 200)) AS lag) l, s o WHERE o.user_id = s.user_id AND o.j = s.j + lag GROUP BY s.user_id, lag),
        e AS (SELECT user_id, sqrt(sum(x * x) / 512) AS rms, sum(x * x) AS r0, sum(abs(sign(x) - sign(p))) FILTER (WHERE p IS NOT NULL) / 511 / 2 AS zcr FROM (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY j) AS p FROM s) GROUP BY user_id),
        n AS (SELECT a.user_id, lag, r / (r0 + 1e-10) AS r FROM a JOIN e USING (user_id)),
        b AS (SELECT user_id, least(greatest(max(r), 0), 1 - 1e-10) AS peak, arg_max(lag, r) FILTER (WHERE lag >= 40) AS best, max(r) FILTER (WHERE lag >= 40) AS strength FROM n GROUP BY user_id),
        c AS (SELECT *, sum(m * m) OVER (PARTITION BY user_id ORDER BY k) AS run, sum(m * m) OVER (PARTITION BY user_id) AS whole FROM m),
        mel AS (SELECT i, 700 * (10 ** ((lo + (hi - lo) * i / 13) / 2595) - 1) AS hz FROM (SELECT unnest(range(14)) AS i, 2595 * log10(1 + 80 / 700.0::DOUBLE) AS lo, 2595 * log10(1 + 4000 / 700.0::DOUBLE) AS hi)),
        band AS (SELECT u.i - 1 AS i, l.hz AS lo, u.hz AS mid, h2.hz AS hi FROM mel l JOIN mel u ON u.i = l.i + 1 JOIN mel h2 ON h2.i = l.i + 2),
        q AS (SELECT user_id, i, ln(coalesce(sum(m * m * greatest(0, least((f - lo) / (mid - lo), (hi - f) / (hi - mid)))), 0) + 1e-10) AS e FROM m, band GROUP BY user_id, i),
        d AS (SELECT user_id, sum(e * cos({CIRCLE} / 2 * (i + 0.5) / 12)) AS mfcc1, sum(e * cos({CIRCLE} * (i + 0.5) / 12)) AS mfcc2 FROM q GROUP BY user_id),
        z AS (SELECT user_id, sum(m * m) + 1e-10 AS total, sum(m * m) FILTER (WHERE f BETWEEN 80 AND 3400) AS voice, sum((m + 1e-10) ** 2) FILTER (WHERE f BETWEEN 200 AND 3400) AS speech, max((m + 1e-10) ** 2) FILTER (WHERE f BETWEEN 200 AND 3400) AS top, sum((m + 1e-10) ** 2) AS raised, sum(f * m * m) AS moment,
                     exp(avg(ln(m + 2e-10)) FILTER (WHERE f BETWEEN 80 AND 3400)) / (avg(m + 1e-10) FILTER (WHERE f BETWEEN 80 AND 3400) + 1e-10) AS flatness, exp(avg(ln(m + 1e-10))) / avg(m + 1e-10) AS full_flatness, count(*) FILTER (WHERE run < 0.85 * (whole + 1e-10)) * 31.25 AS rolloff FROM c GROUP BY user_id)"""

#: u has the fused score x of each vector against label 0.
VERIFIED = f"""e AS (SELECT vec_id, label, embedding AS f, list_transform(embedding[1:10], lambda x: x::DOUBLE * x::DOUBLE * 400) AS v, sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) AS n FROM embeddings),
        c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(list_transform(f, lambda x: x::DOUBLE / n)) AS x, generate_subscripts(f, 1) AS i FROM e WHERE label = 0 AND n > 1e-8) GROUP BY i)),
        w AS (SELECT list(m ORDER BY i) AS w FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE label = 0 AND list_max(v) > 1) GROUP BY i)),
        s AS (SELECT vec_id, {COS.format(a="f", b="c")} AS f0, list_sum(list_transform(list_zip(w, v), lambda p: least(p[1], p[2]) / (greatest(p[1], p[2]) + 1e-8))) / 10 AS var FROM e, c, w),
        u AS (SELECT *, 0.65 * greatest(0, f0) + 0.35 * var AS x FROM s)"""

ORACLES = {
    "frame_kernels": f"""WITH {WAVES} SELECT user_id, round(rms, 4) AS rms, round(voice / total, 4) AS band_ratio, round(speech / (raised + 1e-10), 4) AS speech_ratio, round(top / (speech + 1e-10), 4) AS peak_ratio, round(flatness, 4) AS flatness, round(full_flatness, 4) AS full_flatness,
        round(10 * log10(peak / (1 - peak + 1e-10) + 1e-10), 4) AS hnr_db, round(CASE WHEN strength >= 0.3 THEN 16000.0::DOUBLE / best ELSE 0 END, 4) AS f0_hz, round(moment / total, 4) AS centroid, round(least(rolloff, 8000)::DOUBLE, 4) AS rolloff, round(zcr, 4) AS zcr, round(mfcc1, 4) AS mfcc1, round(mfcc2, 4) AS mfcc2
        FROM e JOIN b USING (user_id) JOIN z USING (user_id) JOIN d USING (user_id)""",
    "hysteresis_scan": f"WITH {FRAMES}, {ACTIVE} SELECT user_id, idx, active FROM act",
    "speaker_overlaps": f"""WITH {FRAMES}, {ACTIVE}, {SEGMENTS}, p AS (SELECT user_id, event_type, idx::DOUBLE AS a, (idx + floor(value / 8) + 1)::DOUBLE AS b FROM fr)
        SELECT p.user_id, event_type, count(*) AS n, sum(least(end_s, b) - greatest(start_s, a)) AS seconds FROM p JOIN seg ON seg.user_id = p.user_id AND start_s < b AND a < end_s GROUP BY p.user_id, event_type""",
    "spectral_combs": f"""WITH {WAVES},
        whole AS (SELECT user_id, 3 * median(m) AS lim, sum(m * m) + 1e-10 AS energy FROM m GROUP BY user_id),
        harmonic AS (SELECT f0, round_even(f0 * h / 31.25, 0)::INT AS centre FROM (SELECT unnest(range(80, 400, 5)) AS f0), (SELECT unnest(range(1, 7)) AS h)),
        peak AS (SELECT m.user_id, f0, centre, max(m) AS top FROM harmonic JOIN m ON m.k BETWEEN centre - 2 AND centre + 2 GROUP BY m.user_id, f0, centre),
        cand AS (SELECT user_id, f0, sum(top * top) / any_value(energy) AS score, count(*) AS n FROM peak JOIN whole USING (user_id) WHERE top > lim GROUP BY user_id, f0 HAVING count(*) >= 4 AND sum(top * top) / any_value(energy) >= 0.08),
        best AS (SELECT user_id, list(struct_pack(f := f0, s := score, n := n) ORDER BY round(score, 9) DESC, f0) AS c FROM cand GROUP BY user_id),
        kept AS (SELECT user_id, list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k.f - x[1].f) < 15)) = 0 THEN list_concat(acc, x) ELSE acc END) AS c FROM (SELECT user_id, list_transform(c, lambda x: [x]) AS c FROM best)),
        every AS (SELECT user_id, coalesce(c, []) AS c FROM whole LEFT JOIN kept USING (user_id)),
        strong AS (SELECT *, list_filter(c[2:], lambda x: x.s >= c[1].s * 0.45) AS o FROM every)
        SELECT user_id, len(c)::BIGINT AS n, c[1].f::DOUBLE AS f0_hz, round(c[1].s, 7) AS score, c[1].n AS n_harmonics, round(CASE WHEN len(c) < 2 THEN 0 WHEN len(o) = 0 THEN 0.1 ELSE least(greatest((o[1].s / (c[1].s + 1e-10) - 0.3) / 0.2, 0), 1) END, 6) AS confidence FROM strong""",
    "voice_gate": f"WITH {GATE} SELECT user_id, idx, score, score >= 2 AS is_voice, round(CASE WHEN score >= 2 THEN value / 100 ELSE 0 END, 9) AS confidence FROM g",
    "noise_counts": f"WITH {GATE} SELECT user_id, count(*) FILTER (WHERE score >= 2) AS voice, count(*) FILTER (WHERE score < 2) AS noise, round(100.0::DOUBLE * count(*) FILTER (WHERE score < 2) / count(*), 9) AS noise_pct FROM g GROUP BY user_id",
    "two_voices": f"""WITH {FRAMES}, h AS (SELECT user_id, idx, list_reverse_sort(list_filter(list(value) OVER (PARTITION BY user_id ORDER BY idx ROWS 2 PRECEDING), lambda x: x >= 15)) AS v FROM fr),
        s AS (SELECT *, list_filter(v[2:], lambda x: x >= v[1] * 0.45) AS strong FROM h)
        SELECT user_id, idx, round(CASE WHEN len(v) < 2 THEN 0 WHEN len(strong) = 0 THEN 0.1 ELSE least(greatest((strong[1] / (v[1] + 1e-10) - 0.3) / 0.2, 0), 1) END, 9) AS confidence FROM s""",
    "flag_events": f"""WITH {FRAMES}, i AS (SELECT user_id, idx, value / 100 AS c, idx - row_number() OVER {W} AS grp FROM fr WHERE value / 100 >= 0.2)
        SELECT user_id, min(idx) AS start_frame, max(idx) + 1 AS end_frame, round(max(c), 3) AS confidence_max, round(avg(c), 3) AS confidence_avg, (arg_max(idx, c * 1e6 - idx * 1e-3))::BIGINT AS best_frame, CASE WHEN max(c) >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM i GROUP BY user_id, grp HAVING count(*) >= 3 AND max(c) >= 0.75""",
    "turn_comparison": f"WITH RECURSIVE {TURNS} SELECT user_id, turn::BIGINT AS turn, start_frame, end_frame, n, round(f0, 9) AS f0, round(z, 9) AS z, round(CASE WHEN z IS NOT NULL THEN {ZCONF} END, 9) AS confidence, round(rf, 9) AS reference_f0, round(rc, 9) AS reference_centroid, coalesce({ZCONF} >= 0.75 AND z IS NOT NULL, false) AS flagged FROM c",
    "frame_distance": f"""WITH RECURSIVE {TURNS}, d AS (SELECT v.user_id, v.idx, CASE WHEN v.turn > 0 AND row_number() OVER (PARTITION BY v.user_id, v.turn ORDER BY v.idx) >= 3 THEN coalesce(0.65 * CASE WHEN v.f0 > 0 THEN abs(v.f0 - rf) / fs ELSE 0 END + 0.35 * abs(v.cen - rc) / cs, 0) ELSE 0 END AS z FROM v LEFT JOIN c ON c.user_id = v.user_id AND c.turn = v.turn)
        SELECT user_id, idx, round(z, 6) AS z, round({ZCONF}, 6) AS confidence FROM d""",
    "fallback_activity": f"""WITH RECURSIVE {FRAMES}, f AS (SELECT user_id, idx, value / 1000 AS rms, (value * 3) % 1 AS flat, (value * 7) % 1 AS band, (value * 11) % 1 AS peak FROM fr),
        q AS (SELECT user_id, greatest(quantile_cont(rms, 0.2), 1e-5) AS q FROM f WHERE idx < 10 GROUP BY user_id HAVING count(*) = 10),
        r(user_id, idx, score, loud, quiet, was, floor) AS (
            SELECT user_id, -1::BIGINT, 0::DOUBLE, 0, 0, false, 0.005::DOUBLE FROM (SELECT DISTINCT user_id FROM f)
            UNION ALL
            SELECT user_id, idx, score, loud, quiet, is_on, CASE WHEN idx < 9 THEN floor WHEN idx = 9 THEN q WHEN is_on THEN floor ELSE greatest(1e-5, floor * 0.998 + rms * 0.002) END
            FROM (SELECT *, loud >= 2 OR (was AND quiet < 3) AS is_on FROM (
                SELECT *, CASE WHEN score >= 0.45 THEN loud0 + 1 ELSE 0 END AS loud, CASE WHEN score >= 0.45 THEN 0 ELSE quiet0 + 1 END AS quiet FROM (
                    SELECT f.user_id, f.idx, f.rms, r.floor, r.was, r.loud AS loud0, r.quiet AS quiet0, q.q, CASE WHEN f.rms < 2 * r.floor OR flat > 0.65 OR band < 0.08 OR peak > 0.55 THEN 0
                           ELSE 0.45 * least(1, f.rms / (4 * r.floor + 1e-10)) + 0.3 * greatest(0, 1 - flat / 0.65) + 0.25 * least(1, band / 0.45) END AS score
                    FROM r JOIN f ON f.user_id = r.user_id AND f.idx = r.idx + 1 LEFT JOIN q ON q.user_id = r.user_id))))
        SELECT user_id, idx, round(score, 7) AS speech_prob, was AS is_speech, round(floor, 9) AS floor FROM r WHERE idx >= 0""",
    "merged_segments": f"""WITH RECURSIVE {FRAMES}, {ACTIVE}, {SEGMENTS},
        l AS (SELECT seg.user_id, start_s, end_s, avg(value) AS rms, row_number() OVER (PARTITION BY seg.user_id ORDER BY start_s) AS k FROM seg JOIN fr ON fr.user_id = seg.user_id AND fr.idx >= start_s AND fr.idx < end_s WHERE end_s - start_s >= 2 GROUP BY seg.user_id, start_s, end_s),
        r(user_id, k, a, b, rms, n) AS (
            SELECT user_id, k, start_s, end_s, rms, 1::BIGINT FROM l WHERE k = 1
            UNION ALL
            SELECT l.user_id, l.k, CASE WHEN l.start_s - r.b < 4 THEN r.a ELSE l.start_s END, l.end_s, CASE WHEN l.start_s - r.b < 4 THEN (r.rms * (r.b - r.a) + l.rms * (l.end_s - l.start_s)) / (r.b - r.a + l.end_s - l.start_s) ELSE l.rms END, CASE WHEN l.start_s - r.b < 4 THEN r.n + 1 ELSE 1 END
            FROM r JOIN l ON l.user_id = r.user_id AND l.k = r.k + 1)
        SELECT user_id, greatest(0, a - 1)::DOUBLE AS start_s, b + 1 AS end_s, round(rms, 7) AS rms, n, rms < 5 * 8.0 AS is_whisper FROM (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY k) AS next_a FROM r) WHERE next_a IS NULL OR next_a <> a""",
    "verified_voices": f"""WITH {VERIFIED} SELECT vec_id, round_even(x, 4) AS similarity, round_even(f0, 4) AS sim_f0, round_even(var, 4) AS sim_var, round_even(CASE WHEN x >= 0.72 THEN least(1, 0.75 + (x - 0.72) / 0.28) WHEN x >= 0.55 THEN 0.5 + 0.25 * (x - 0.55) / 0.17 WHEN x >= 0.35 THEN 0.25 * (x - 0.35) / 0.2 ELSE least(1, (0.35 - x) / 0.2) END, 3) AS confidence,
               CASE WHEN x >= 0.72 THEN 'MATCH' WHEN x >= 0.55 THEN 'LIKELY' WHEN x >= 0.35 THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS verdict FROM u""",
    "flagged_voices": f"WITH {VERIFIED} SELECT label, count(*) FILTER (WHERE x < 0.55) AS flagged, count(*) FILTER (WHERE x >= 0.55) AS enrolled FROM u JOIN embeddings USING (vec_id) GROUP BY label",
    "merged_flags": f"""WITH {FRAMES}, b AS (SELECT user_id, idx::DOUBLE AS start_s, (idx + floor(value / 40) + 1)::DOUBLE AS end_s, CASE event_type WHEN 'click' THEN 'A' ELSE 'B' END AS scenario, value FROM fr WHERE event_type IN ('click', 'purchase') AND value >= 15),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_s) AS grp FROM (SELECT *, coalesce((start_s > max(end_s) OVER (PARTITION BY user_id ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5)::INT, 1) AS new FROM b))
        SELECT user_id, min(start_s) AS start_s, max(end_s) AS end_s, CASE WHEN count(*) > 1 THEN 'MULTIPLE_SPEAKERS_DETECTED' WHEN min(scenario) = 'A' THEN 'MULTIPLE_SPEAKERS_SIMULTANEOUS' ELSE 'POSSIBLE_VOICE_CHANGE' END AS kind, CASE WHEN count(DISTINCT scenario) > 1 THEN 'AB' ELSE min(scenario) END AS scenario,
               round(max(value) / 100, 9) AS confidence, CASE WHEN max(value) / 100 >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(arg_min(value, start_s), 2)::VARCHAR AS z, CASE WHEN count(*) > 1 THEN round(arg_max(value, start_s), 2)::VARCHAR END AS merged_with FROM g GROUP BY user_id, grp""",
    "smooth_histogram": """WITH b AS (SELECT event_type, least(floor((value - 60) / 4.25)::INT + 1, 80) AS bin, count(*) AS n FROM events WHERE value >= 60 AND value <= 400 GROUP BY ALL),
        k AS (SELECT d, exp(-0.5 * (d / 2.0::DOUBLE) ** 2) AS w FROM (SELECT unnest(range(-6, 7)) AS d)), s AS (SELECT event_type, bin + d AS bin, sum(n * w / (SELECT sum(w) FROM k)) AS x FROM b, k WHERE bin + d BETWEEN 1 AND 80 GROUP BY ALL)
        SELECT event_type, bin::BIGINT AS bin, round(x / sqrt(sum(x * x) OVER (PARTITION BY event_type)), 7) AS share FROM s""",
    "enrolment_chunks": f"""WITH {FRAMES}, c AS (SELECT user_id, idx // 20 AS chunk, count(*) AS n, sum(value) AS total FROM fr GROUP BY ALL), k AS (SELECT *, max(n >= 8) OVER (PARTITION BY user_id) AS held FROM c)
        SELECT user_id, chunk, n, round(total, 7) AS total FROM k WHERE n >= 8 UNION ALL SELECT user_id, 0, sum(n)::BIGINT, round(sum(total), 7) FROM k WHERE NOT held GROUP BY user_id""",
    "rechunked_blocks": f"WITH {FRAMES} SELECT user_id, idx // 16 AS frame_idx, round(sum(value), 7) AS total FROM fr GROUP BY ALL HAVING count(*) = 16",
    "speaker_audio": f"""WITH {FRAMES}, s AS (SELECT user_id, event_type, idx AS a FROM fr WHERE idx % 4 = 0), n AS (SELECT user_id, count(*) AS n FROM fr GROUP BY user_id)
        SELECT s.user_id, s.event_type, n, round(sum(fr.value::FLOAT::DOUBLE), 3) AS total FROM s JOIN fr ON fr.user_id = s.user_id AND fr.idx >= a AND fr.idx < a + 4 JOIN n ON n.user_id = s.user_id GROUP BY s.user_id, s.event_type, n""",
    "silence_gate": f"""WITH {FRAMES}, g AS (SELECT user_id, 0.65::DOUBLE * coalesce(quantile_cont(value, 0.5) FILTER (WHERE value > 5), 0.02) AS gate FROM fr GROUP BY user_id)
        SELECT user_id, round(max(gate), 9) AS gate, count(*) FILTER (WHERE value > gate) AS voiced FROM fr JOIN g USING (user_id) GROUP BY user_id""",
    "level_plot": f"WITH {FRAMES} SELECT user_id, idx, value, round(CASE WHEN count(*) OVER (PARTITION BY user_id) > 5 THEN sum(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE value END, 7) AS smooth, value > median(value) OVER (PARTITION BY user_id) AS over_median FROM fr",
    "report_lines": f"WITH {FRAMES}, {ACTIVE}, {SEGMENTS} SELECT -1::BIGINT AS line, 'SEGMENTS' AS text UNION ALL SELECT user_id, printf('user %d: %d segments, %.1f s', user_id, count(*), sum(end_s - start_s)) FROM seg GROUP BY user_id",
}
