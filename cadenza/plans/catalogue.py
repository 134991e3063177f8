"""Named queries over the driver's tables, with DuckDB twins.

``events`` plays the part of recordings: user_id is the recording, the rank by (ts, event_id) the
frame, value the level. ``embeddings`` plays the part of voices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import folds, islands, joins, rolling, rules, vectors

K = ["user_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, idx, value, event_type: events in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_type", "value", (F.row_number().over(w) - 1).cast("long").alias("idx"))


FRAMES = "fr AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
#: on after 3 rows over the level, off after 4 under it: the decision looks at the last rows only, then carries forward
ACTIVE = """
    act AS (
        SELECT *, coalesce(last_value(CASE WHEN c3 = 3 AND m3 > 20 THEN true WHEN c4 = 4 AND m4 <= 20 THEN false END IGNORE NULLS)
                           OVER (PARTITION BY user_id ORDER BY idx), false) AS active
        FROM (SELECT *, count(*) OVER a AS c3, min(value) OVER a AS m3, count(*) OVER b AS c4, max(value) OVER b AS m4 FROM fr
              WINDOW a AS (PARTITION BY user_id ORDER BY idx ROWS 2 PRECEDING), b AS (PARTITION BY user_id ORDER BY idx ROWS 3 PRECEDING)))"""
SEGMENTS = """
    seg AS (
        SELECT user_id, min(idx)::DOUBLE AS start_s, (max(nxt))::DOUBLE AS end_s
        FROM (SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS grp
              FROM (SELECT *, coalesce(lead(idx) OVER (PARTITION BY user_id ORDER BY idx), idx + 1) AS nxt FROM act) WHERE active)
        GROUP BY user_id, grp)"""


def active(spark: SparkSession, sf: str) -> DataFrame:
    return islands.hysteresis(frames(spark, sf), K, ["idx"], F.col("value") > 20, 3, 4)


def hysteresis_state(spark: SparkSession, sf: str) -> DataFrame:
    return active(spark, sf).select("user_id", "idx", "active")


def vad_segments(spark: SparkSession, sf: str) -> DataFrame:
    return islands.state_segments(active(spark, sf), K, "idx", "active")


def merge_close_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Merge gaps under 3, then widen by 1 on either side."""
    merged = islands.merge_intervals(vad_segments(spark, sf), K, "start_s", "end_s", 3.0, {"n": F.count("*")}, strict=True)
    return merged.select("user_id", F.greatest(F.lit(0.0), F.col("start_s") - 1).alias("start_s"), (F.col("end_s") + 1).alias("end_s"), "n")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hysteresis, islands, gap merge, then speech per user."""
    merged = merge_close_segments(spark, sf)
    return merged.groupBy("user_id").agg(F.count("*").alias("segments"), F.round(F.sum(F.col("end_s") - F.col("start_s")), 9).alias("speech_s"))


def energy_islands(spark: SparkSession, sf: str) -> DataFrame:
    gated = frames(spark, sf).withColumn("gate", F.percentile("value", 0.5).over(Window.partitionBy("user_id")))
    return islands.energy_segments(gated, K, "idx", F.col("value") > F.col("gate") * 0.65, 2, 4).select("user_id", F.col("segment").cast("long"), "start_frame", "end_frame")


def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams of events as intervals; a mixed group is AB."""
    both = frames(spark, sf).where(F.col("event_type").isin("click", "purchase")).select("user_id", F.when(F.col("event_type") == "click", "A").otherwise("B").alias("scenario"), F.col("idx").cast("double").alias("start_s"), (F.col("idx") + F.floor(F.col("value") / 40)).cast("double").alias("end_s"))
    merged = islands.merge_intervals(both, K, "start_s", "end_s", 0.5, {"n": F.count("*"), "kinds": F.count_distinct("scenario"), "one": F.min("scenario")})
    return merged.select("user_id", "start_s", "end_s", "n", F.when(F.col("kinds") > 1, "AB").otherwise(F.col("one")).alias("scenario"))


def rolling_cv_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.cv_gate(frames(spark, sf), K, ["idx"], "value").select("user_id", "idx", F.round("cv", 9).alias("cv"), "passed")


def moving_average5(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.moving_average(frames(spark, sf).where("value > 20"), K, ["idx"], "value").select("user_id", "idx", F.round("smooth", 9).alias("smooth"))


def centred_smooth5(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.centred_smooth(frames(spark, sf), K, ["idx"], "value").select("user_id", "idx", F.round("smooth", 9).alias("smooth"))


def sustained_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = islands.islands(frames(spark, sf), K, "idx", F.col("value") > 20)
    return found.groupBy("user_id", "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean")).where("n >= 4").select("user_id", "first_idx", "n", "mean")


def state_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return islands.transitions(frames(spark, sf), K, ["idx"], "event_type").select("user_id", "idx", "previous", F.col("event_type").alias("state"))


def per_bucket_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return active(spark, sf).groupBy("user_id", F.floor(F.col("idx") / 10).alias("bucket")).agg(F.round(100 * F.avg(F.col("active").cast("int")), 9).alias("speech_pct"), F.round(F.avg("value"), 9).alias("mean_value"), F.count("*").alias("n"))


def turn_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Turns: voiced frames parted by more than two silent ones; the first five voiced frames enrol."""
    voiced = frames(spark, sf).where("value > 25").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("idx"))).where("rank > 5")
    turns = islands.islands(voiced, K, "idx", F.lit(True), 3)
    return turns.groupBy("user_id", F.col("island").alias("turn")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.min("idx").alias("first_idx"))


def reference_profile(spark: SparkSession, sf: str) -> DataFrame:
    first = frames(spark, sf).where("value > 25").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("idx"))).where("rank <= 20")
    return first.groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.greatest(F.stddev_pop("value"), F.lit(1.0)), 9).alias("std"), F.count("*").alias("n"))


def turn_zscore(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    ranked = frames(spark, sf).where("value > 25").withColumn("rank", F.row_number().over(w.orderBy("idx")))
    own = F.when(F.col("rank") <= 20, F.col("value"))
    z = F.abs(F.col("value") - F.avg(own).over(w)) / F.greatest(F.stddev_pop(own).over(w), F.lit(1.0))
    scored = ranked.withColumn("z", z).where("rank > 20")
    return scored.select("user_id", "idx", F.round("z", 9).alias("z"), F.round(rules.z_confidence(F.col("z")), 9).alias("confidence"), rules.severity(rules.z_confidence(F.col("z"))).alias("severity"))


def noise_floor_fold(spark: SparkSession, sf: str) -> DataFrame:
    marked = frames(spark, sf).withColumn("speech", F.col("value") > 60)
    return folds.noise_floor(marked, K, ["idx"], "value", "speech", calibrate=10).select("user_id", "idx", F.round("floor", 9).alias("floor"))


def ema_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.ema(frames(spark, sf), K, ["idx"], "value", 0.05).select("user_id", F.round("ema", 9).alias("ema"))


def cooldown_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return folds.cooldown(frames(spark, sf), ["user_id", "event_type"], "idx", 10)


def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return folds.greedy_apart(frames(spark, sf).where("value > 60"), K, "idx", "value", 3).select("user_id", "idx", "value")


def asof_latest_flag(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    right = f.where("event_type = 'view'").select("user_id", F.col("idx").alias("at"), F.col("value").alias("flag"))
    return joins.latest_before(f.where("event_type = 'click'").select("user_id", "idx"), right, K, "idx", "at", "flag", "latest")


def evidence_window(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("idx").rowsBetween(-9, 0)
    return frames(spark, sf).withColumn("held", F.collect_list("value").over(w)).where("event_type = 'purchase'").select("user_id", "idx", F.size("held").cast("long").alias("n"), F.round(F.aggregate("held", F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


def voiced_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    found = rolling.voiced_groups(frames(spark, sf), K, ["idx"], F.col("value") > 20, 7)
    return found.groupBy("user_id", "group").agg(F.max("idx").alias("at"), F.round(F.sum("value"), 9).alias("total"))


def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Values inside merged segments, 0 elsewhere."""
    at = frames(spark, sf).withColumn("ts", F.col("idx").cast("double"))
    found = joins.in_intervals(at, merge_close_segments(spark, sf), K, "ts", "start_s", "end_s")
    return found.select("user_id", "idx", F.when(F.col("inside"), F.col("value")).otherwise(0.0).alias("value"))


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("idx")
    return frames(spark, sf).select("user_id", "idx", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("score"), F.sum((F.col("event_type") == "signup").cast("long")).over(w).alias("speakers"))


def percentile_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.percentile_threshold(frames(spark, sf), K, "value", 0.15, 5.0, 0.012, 10).groupBy("user_id").agg(F.round(F.max("gate"), 9).alias("gate"), F.count_if(F.col("value") > F.col("gate")).alias("voiced"))


def speaker_stats(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 9).alias("median_value"), F.round(F.sum("value"), 9).alias("total"))


def flag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.count("*").alias("total"), F.count_if(F.col("value") >= 90).alias("high"), F.count_if(F.col("value") < 90).alias("medium"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.sum("value"), 2).alias("duration"))


def verdict_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """All four verdicts, also those that none has."""
    names = spark.createDataFrame([("MATCH",), ("LIKELY",), ("UNCERTAIN",), ("MISMATCH",)], "verdict string")
    counts = table(spark, sf, "events").groupBy(vectors.verdict(F.col("value") / 100).alias("verdict")).agg(F.count("*").alias("n"))
    return names.join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "idx")
    return frames(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2").select("user_id", "rank", "idx", "value")


def anti_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order of over 400,000."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def union_events(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    a = f.where("event_type = 'click'").select("user_id", F.lit("A").alias("scenario"), "idx")
    b = f.where("event_type = 'purchase'").select("user_id", F.lit("B").alias("scenario"), "idx", "value")
    return a.unionByName(b, allowMissingColumns=True)


def histogram_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """20 bins of value over [0, 400], the last one closed, smoothed by a triangle over neighbouring bins."""
    bins = table(spark, sf, "events").where("value >= 0 and value <= 400").groupBy(F.least(F.expr("width_bucket(value, 0, 400, 20)"), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))
    spread = bins.select(F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), (F.col("n") * (3 - abs(d)) / 9).alias("part")) for d in range(-2, 3)])).alias("s")).select("s.*")
    return spread.where("bin between 1 and 20").groupBy("bin").agg(F.round(F.sum("part"), 9).alias("smooth"))


def pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of one label with a similarity of 0.25 or more."""
    found = vectors.similar_pairs(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.25)
    return found.select("a", "b", F.round("similarity", 5).alias("similarity"))


def pair_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of neighbouring vectors of a label: the first items stand for pitch and flatness."""
    w = Window.partitionBy("label").orderBy("vec_id")
    pitch, flat = (lambda v: F.abs(v[0].cast("double")) * 1000), (lambda v: F.abs(v[1].cast("double")) * 2)
    e = table(spark, sf, "embeddings").withColumn("other", F.lead("embedding").over(w)).where("other is not null")
    v, o = F.col("embedding"), F.col("other")
    similarity, threshold = vectors.pair_regime(vectors.cosine(v, o), pitch(v), pitch(o), flat(v), flat(o))
    return e.select("vec_id", F.round(similarity, 5).alias("similarity"), threshold.alias("threshold"))


def centroid_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against its label's centroid."""
    e = table(spark, sf, "embeddings")
    met = e.join(vectors.centroids(e, ["label"], "embedding"), "label").withColumn("score", vectors.cosine(F.col("embedding"), F.col("centroid")))
    return met.select("vec_id", F.round("score", 5).alias("score"), vectors.verdict(F.col("score") * 2).alias("verdict"))


def variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    squared = lambda c: F.transform(c, lambda x: x.cast("double") * x.cast("double"))
    e = table(spark, sf, "embeddings").withColumn("other", F.lead("embedding").over(w)).where("other is not null")
    return e.select("vec_id", F.round(vectors.variance_ratio(squared(F.col("embedding")), squared(F.col("other"))), 5).alias("ratio"))


def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.nearest(e, vectors.centroids(e, ["label"], "embedding"), "vec_id", "embedding", "label", "centroid", 0.1).select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


def online_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.track_online(table(spark, sf, "embeddings"), ["label"], ["vec_id"], "embedding", 0.25)


def agglomerative(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    pairs = vectors.similar_pairs(e, "label", "vec_id", "embedding", 0.25).withColumn("threshold", F.lit(0.3))
    return vectors.agglomerate(pairs, e.select("label", F.col("vec_id").alias("node")), "label")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return active(spark, sf).select("user_id", "idx", F.col("active").alias("speech"), (F.col("event_type") == "click").alias("lips"), (F.col("value") % 1).alias("score"), (F.col("idx") % 5 == 0).cast("int").alias("extra")).withColumn("speakers", F.col("extra") + 1)


def fusion_decision(spark: SparkSession, sf: str) -> DataFrame:
    found = _signals(spark, sf).withColumn("event", rules.fusion_decision(F.col("speech"), F.col("lips"), F.col("score"), F.col("speakers"))).where("event is not null")
    return found.select("user_id", "idx", "event", F.round(rules.event_confidence(F.col("event"), F.col("lips"), F.col("score"), F.col("speakers")), 9).alias("confidence"))


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    scored = F.when(F.col("score") >= 0.05, F.col("score"))
    return _signals(spark, sf).groupBy("user_id").agg(F.count("*").alias("chunks"), F.round(F.count_if(F.col("speech")) * 0.032, 9).alias("speech_s"), F.round(F.coalesce(F.avg(scored), F.lit(0.0)), 9).alias("score_mean"), F.round(F.coalesce(F.min(scored), F.lit(0.0)), 9).alias("score_min"), F.max("speakers").cast("long").alias("speakers"))


QUERIES = {
    f.__name__: f
    for f in (
        hysteresis_state, vad_segments, merge_close_segments, flagship, energy_islands, interval_merge, rolling_cv_gate, moving_average5, centred_smooth5, sustained_runs, state_transitions,
        per_bucket_rollup, turn_stats, reference_profile, turn_zscore, noise_floor_fold, ema_fold, cooldown_thinning, greedy_dedup, asof_latest_flag, evidence_window, voiced_accumulate, interval_join,
        carry_forward, percentile_gate, speaker_stats, flag_summary, verdict_histogram, topk_per_group, anti_scan, union_events, histogram_smooth, pairwise_cosine, pair_regimes, centroid_verdict,
        variance_ratio, nearest_centroid, online_cluster, agglomerative, fusion_decision, session_summary,
    )
}

W = "(PARTITION BY user_id ORDER BY idx)"
MERGED = SEGMENTS + """,
    mrg AS (
        SELECT user_id, greatest(0, min(start_s) - 1)::DOUBLE AS start_s, max(end_s) + 1 AS end_s, count(*) AS n
        FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_s) AS grp
              FROM (SELECT *, coalesce((start_s - max(end_s) OVER (PARTITION BY user_id ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3)::INT, 1) AS new FROM seg))
        GROUP BY user_id, grp)"""
ZCONF = "CASE WHEN z < 4 THEN least(greatest(z / 8, 0), 0.49) ELSE least(greatest(0.5 + (z - 4) / 6, 0.5), 1) END"
SIGNALS = f"WITH {FRAMES}, {ACTIVE}, sig AS (SELECT user_id, idx, active AS speech, event_type = 'click' AS lips, value % 1 AS score, CASE WHEN idx % 5 = 0 THEN 2 ELSE 1 END AS speakers FROM act)"
COS = "list_dot_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE)) / greatest(sqrt(list_dot_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({a}, lambda x: x::DOUBLE))) * sqrt(list_dot_product(list_transform({b}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE))), 1e-12)"
NEXT = "(SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings)"
CENTRES = "cen AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"

ORACLES = {
    "hysteresis_state": f"WITH {FRAMES}, {ACTIVE} SELECT user_id, idx, active FROM act",
    "vad_segments": f"WITH {FRAMES}, {ACTIVE}, {SEGMENTS} SELECT user_id, start_s, end_s FROM seg",
    "merge_close_segments": f"WITH {FRAMES}, {ACTIVE}, {MERGED} SELECT * FROM mrg",
    "flagship": f"WITH {FRAMES}, {ACTIVE}, {MERGED} SELECT user_id, count(*) AS segments, round(sum(end_s - start_s), 9) AS speech_s FROM mrg GROUP BY user_id",
    "energy_islands": f"""WITH {FRAMES}, v AS (SELECT * FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS gate, max(idx) OVER (PARTITION BY user_id) + 1 AS n FROM fr) WHERE value > gate * 0.65),
        i AS (SELECT *, sum(new) OVER {W} AS grp FROM (SELECT *, coalesce((idx - lag(idx) OVER {W} > 2)::INT, 1) AS new FROM v)),
        s AS (SELECT user_id, min(idx) AS start_frame, CASE WHEN max(n) - (max(idx) + 1) < 2 THEN max(n) ELSE max(idx) + 1 END AS end_frame FROM i GROUP BY user_id, grp)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) - 1 AS segment, start_frame, end_frame FROM s WHERE end_frame - start_frame >= 4""",
    "interval_merge": f"""WITH {FRAMES}, b AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'A' ELSE 'B' END AS scenario, idx::DOUBLE AS start_s, (idx + floor(value / 40))::DOUBLE AS end_s FROM fr WHERE event_type IN ('click', 'purchase')),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_s) AS grp FROM (SELECT *, coalesce((start_s > max(end_s) OVER (PARTITION BY user_id ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5)::INT, 1) AS new FROM b))
        SELECT user_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n, CASE WHEN count(DISTINCT scenario) > 1 THEN 'AB' ELSE min(scenario) END AS scenario FROM g GROUP BY user_id, grp""",
    "rolling_cv_gate": f"""WITH {FRAMES} SELECT user_id, idx, round(cv, 9) AS cv, n < 12 OR cv BETWEEN 0.15 AND 2.5 AS passed FROM (SELECT *, stddev_pop(value) OVER w / (avg(value) OVER w + 1e-10) AS cv, count(*) OVER w AS n FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS 39 PRECEDING))""",
    "moving_average5": f"WITH {FRAMES} SELECT user_id, idx, round(avg(value) OVER (PARTITION BY user_id ORDER BY idx ROWS 4 PRECEDING), 9) AS smooth FROM fr WHERE value > 20",
    "centred_smooth5": f"WITH {FRAMES} SELECT user_id, idx, round(CASE WHEN count(*) OVER (PARTITION BY user_id) > 5 THEN sum(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE value END, 9) AS smooth FROM fr",
    "sustained_runs": f"WITH {FRAMES} SELECT user_id, min(idx) AS first_idx, count(*) AS n, round(avg(value), 9) AS mean FROM (SELECT *, idx - row_number() OVER {W} AS grp FROM fr WHERE value > 20) GROUP BY user_id, grp HAVING count(*) >= 4",
    "state_transitions": f"WITH {FRAMES} SELECT * FROM (SELECT user_id, idx, lag(event_type) OVER {W} AS previous, event_type AS state FROM fr) WHERE previous <> state",
    "per_bucket_rollup": f"WITH {FRAMES}, {ACTIVE} SELECT user_id, idx // 10 AS bucket, round(100 * avg(active::INT), 9) AS speech_pct, round(avg(value), 9) AS mean_value, count(*) AS n FROM act GROUP BY user_id, idx // 10",
    "turn_stats": f"""WITH {FRAMES}, v AS (SELECT *, row_number() OVER {W} AS rank FROM fr WHERE value > 25), t AS (SELECT *, coalesce((idx - lag(idx) OVER {W} > 3)::INT, 1) AS new FROM v WHERE rank > 5)
        SELECT user_id, turn, count(*) AS n, round(avg(value), 9) AS mean, min(idx) AS first_idx FROM (SELECT *, sum(new) OVER {W}::BIGINT AS turn FROM t) GROUP BY user_id, turn""",
    "reference_profile": f"WITH {FRAMES} SELECT user_id, round(avg(value), 9) AS mean, round(greatest(stddev_pop(value), 1.0), 9) AS std, count(*) AS n FROM (SELECT *, row_number() OVER {W} AS rank FROM fr WHERE value > 25) WHERE rank <= 20 GROUP BY user_id",
    "turn_zscore": f"""WITH {FRAMES}, v AS (SELECT *, row_number() OVER {W} AS rank FROM fr WHERE value > 25), p AS (SELECT user_id, avg(value) AS m, greatest(stddev_pop(value), 1.0) AS s FROM v WHERE rank <= 20 GROUP BY user_id),
        z AS (SELECT user_id, idx, abs(value - m) / s AS z FROM v JOIN p USING (user_id) WHERE rank > 20)
        SELECT user_id, idx, round(z, 9) AS z, round({ZCONF}, 9) AS confidence, CASE WHEN {ZCONF} >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM z""",
    "noise_floor_fold": f"""WITH RECURSIVE {FRAMES}, q AS (SELECT user_id, greatest(quantile_cont(value, 0.2), 1e-5) AS q FROM fr WHERE idx < 10 GROUP BY user_id HAVING count(*) = 10),
        f(user_id, idx, floor) AS (
            SELECT fr.user_id, fr.idx, CASE WHEN fr.idx < 9 THEN 0.005 ELSE q.q END FROM fr LEFT JOIN q USING (user_id) WHERE fr.idx <= 9
            UNION ALL SELECT f.user_id, fr.idx, CASE WHEN fr.value > 60 THEN f.floor ELSE greatest(1e-5, f.floor * 0.998 + fr.value * 0.002) END FROM f JOIN fr ON fr.user_id = f.user_id AND fr.idx = f.idx + 1 WHERE f.idx >= 9)
        SELECT user_id, idx, round(floor, 9) AS floor FROM f""",
    "ema_fold": f"WITH {FRAMES} SELECT user_id, round(list_reduce(list(value ORDER BY idx), lambda a, x: a * 0.95 + x * 0.05), 9) AS ema FROM fr GROUP BY user_id",
    "cooldown_thinning": f"""WITH RECURSIVE {FRAMES}, f(user_id, event_type, idx) AS (
            SELECT user_id, event_type, min(idx) FROM fr GROUP BY user_id, event_type
            UNION ALL SELECT * FROM (SELECT f.user_id, f.event_type, min(fr.idx) AS idx FROM f JOIN fr ON fr.user_id = f.user_id AND fr.event_type = f.event_type AND fr.idx >= f.idx + 10 GROUP BY f.user_id, f.event_type))
        SELECT user_id, event_type, idx FROM f""",
    "greedy_dedup": f"""WITH RECURSIVE {FRAMES}, o AS (SELECT user_id, idx, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, idx) AS k FROM fr WHERE value > 60),
        r(user_id, k, kept) AS (
            SELECT user_id, k, [idx] FROM o WHERE k = 1
            UNION ALL SELECT o.user_id, o.k, CASE WHEN list_min(list_transform(r.kept, lambda x: abs(x - o.idx))) < 3 THEN r.kept ELSE list_append(r.kept, o.idx) END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
        SELECT user_id, idx, fr.value FROM (SELECT user_id, unnest(arg_max(kept, k)) AS idx FROM r GROUP BY user_id) JOIN fr USING (user_id, idx)""",
    "asof_latest_flag": f"WITH {FRAMES} SELECT l.user_id, l.idx, r.value AS latest FROM (SELECT * FROM fr WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM fr WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.idx >= r.idx",
    "evidence_window": f"WITH {FRAMES} SELECT user_id, idx, n, round(total, 9) AS total FROM (SELECT *, count(*) OVER w AS n, sum(value) OVER w AS total FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS 9 PRECEDING)) WHERE event_type = 'purchase'",
    "voiced_accumulate": f"""WITH {FRAMES}, v AS (SELECT *, (row_number() OVER {W} - 1) // 7 AS "group" FROM fr WHERE value > 20) SELECT user_id, "group", max(idx) AS at, round(sum(value), 9) AS total FROM v GROUP BY user_id, "group" HAVING count(*) = 7""",
    "interval_join": f"WITH {FRAMES}, {ACTIVE}, {MERGED} SELECT user_id, idx, CASE WHEN EXISTS (SELECT 1 FROM mrg WHERE mrg.user_id = fr.user_id AND fr.idx >= mrg.start_s AND fr.idx < mrg.end_s) THEN value ELSE 0.0 END AS value FROM fr",
    "carry_forward": f"WITH {FRAMES} SELECT user_id, idx, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER {W} AS score, (sum((event_type = 'signup')::INT) OVER {W})::BIGINT AS speakers FROM fr",
    "percentile_gate": f"""WITH {FRAMES}, g AS (SELECT user_id, greatest(coalesce(CASE WHEN count(*) FILTER (WHERE value > 5) >= 10 THEN quantile_cont(value, 0.15) FILTER (WHERE value > 5) END, 0.012), 0.012) AS gate FROM fr GROUP BY user_id)
        SELECT user_id, round(max(gate), 9) AS gate, count(*) FILTER (WHERE value > gate) AS voiced FROM fr JOIN g USING (user_id) GROUP BY user_id""",
    "speaker_stats": "SELECT user_id, event_type, count(*) AS n, round(median(value), 9) AS median_value, round(sum(value), 9) AS total FROM events GROUP BY user_id, event_type",
    "flag_summary": "SELECT count(*) AS total, count(*) FILTER (WHERE value >= 90) AS high, count(*) FILTER (WHERE value < 90) AS medium, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value), 2) AS duration FROM events",
    "verdict_histogram": "SELECT verdict, count(value) AS n FROM (VALUES ('MATCH'), ('LIKELY'), ('UNCERTAIN'), ('MISMATCH')) d(verdict) LEFT JOIN (SELECT value, CASE WHEN value / 100 >= 0.72 THEN 'MATCH' WHEN value / 100 >= 0.55 THEN 'LIKELY' WHEN value / 100 >= 0.35 THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS v FROM events) ON v = verdict GROUP BY verdict",
    "topk_per_group": f"WITH {FRAMES} SELECT user_id, rank, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, idx) AS rank FROM fr) WHERE rank <= 2",
    "anti_scan": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)",
    "union_events": f"WITH {FRAMES} SELECT user_id, 'A' AS scenario, idx, NULL::DOUBLE AS value FROM fr WHERE event_type = 'click' UNION ALL SELECT user_id, 'B', idx, value FROM fr WHERE event_type = 'purchase'",
    "histogram_smooth": "WITH b AS (SELECT least(floor(value / 20)::INT + 1, 20) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 400 GROUP BY 1) SELECT bin, round(sum(part), 9) AS smooth FROM (SELECT (b.bin + d)::BIGINT AS bin, b.n * (3 - abs(d)) / 9 AS part FROM b, (VALUES (-2), (-1), (0), (1), (2)) k(d)) WHERE bin BETWEEN 1 AND 20 GROUP BY bin",
    "pairwise_cosine": f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format(a='a.embedding', b='b.embedding')}, 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.25",
    "pair_regimes": f"""WITH p AS (SELECT vec_id, {COS.format(a='embedding', b='other')} AS m, abs(embedding[1]::DOUBLE) * 1000 AS fa, abs(other[1]::DOUBLE) * 1000 AS fb, abs(embedding[2]::DOUBLE) * 2 AS xa, abs(other[2]::DOUBLE) * 2 AS xb FROM {NEXT} WHERE other IS NOT NULL),
        q AS (SELECT *, CASE WHEN fa > 0 AND fb > 0 THEN 1 - least(abs(fa - fb) / 340, 1) ELSE m END AS f, 1 - least(abs(xa - xb), 1) AS x, least(xa, xb) > 0.125 AND least(xa, xb) < 0.3 AS w FROM p)
        SELECT vec_id, round(CASE WHEN w THEN 0.5 * m + 0.3 * f + 0.2 * x WHEN fa > 155 AND fb > 155 AND m > 0.92 THEN 0.82 * m + 0.18 * f ELSE 0.6 * m + 0.4 * f END, 5) AS similarity, CASE WHEN w THEN 0.81 ELSE 0.92 END::DOUBLE AS threshold FROM q""",
    "centroid_verdict": f"WITH {CENTRES} SELECT vec_id, round(score, 5) AS score, CASE WHEN score * 2 >= 0.72 THEN 'MATCH' WHEN score * 2 >= 0.55 THEN 'LIKELY' WHEN score * 2 >= 0.35 THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS verdict FROM (SELECT vec_id, {COS.format(a='embedding', b='centroid')} AS score FROM embeddings JOIN cen USING (label))",
    "variance_ratio": f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, other), lambda p: least(p[1]::DOUBLE * p[1]::DOUBLE, p[2]::DOUBLE * p[2]::DOUBLE) / (greatest(p[1]::DOUBLE * p[1]::DOUBLE, p[2]::DOUBLE * p[2]::DOUBLE) + 1e-8))) / len(embedding), 5) AS ratio FROM {NEXT} WHERE other IS NOT NULL",
    "nearest_centroid": f"WITH {CENTRES} SELECT vec_id, label, round(similarity, 5) AS similarity FROM (SELECT vec_id, cen.label, {COS.format(a='embedding', b='centroid')} AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY {COS.format(a='embedding', b='centroid')} DESC, cen.label) AS rank FROM embeddings, cen) WHERE rank = 1 AND similarity >= 0.1",
    "fusion_decision": SIGNALS + """, d AS (SELECT *, CASE WHEN speech AND NOT lips AND score >= 0.05 AND score < 0.4 THEN 'IMPERSONATION' WHEN speech AND NOT lips AND score >= 0.05 AND score >= 0.72 THEN 'GHOST_VOICE' WHEN speech AND speakers >= 2 THEN 'EXTRA_SPEAKER' WHEN speech AND score >= 0.05 AND score < 0.4 THEN 'VOICE_MISMATCH' END AS event FROM sig)
        SELECT user_id, idx, event, round(least(1.0, CASE event WHEN 'IMPERSONATION' THEN (0.4 - score) / 0.4 + CASE WHEN lips THEN 0 ELSE 0.3 END WHEN 'GHOST_VOICE' THEN score WHEN 'EXTRA_SPEAKER' THEN 0.5 + 0.2 * (speakers - 1) ELSE (0.4 - score) / 0.4 END), 9) AS confidence FROM d WHERE event IS NOT NULL""",
    "session_summary": SIGNALS + " SELECT user_id, count(*) AS chunks, round(count(*) FILTER (WHERE speech) * 0.032::DOUBLE, 9) AS speech_s, round(coalesce(avg(score) FILTER (WHERE score >= 0.05), 0), 9) AS score_mean, round(coalesce(min(score) FILTER (WHERE score >= 0.05), 0), 9) AS score_min, max(speakers)::BIGINT AS speakers FROM sig GROUP BY user_id",
}
