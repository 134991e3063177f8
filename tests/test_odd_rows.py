"""Nulls, repeats, large and string ids, empty tables: every operator over keys and vectors; overlaps against brute force; rollups of streams."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import folds, islands, joins, rolling, turns, vectors
from cadenza.streaming import rollups

LARGE = 2**53


def vectors_table(spark, kind="long"):
    one = lambda i: None if i is None else i if kind == "long" else f"id-{i:020}"
    rows = [("a", LARGE, [1.0, 0.0]), ("a", LARGE + 1, [1.0, 0.0]), ("a", None, [1.0, 0.01]), ("a", 5, None), (None, 7, [0.0, 1.0]), (None, 8, [0.0, 2.0]), ("b", 9, [0.0, 0.0]), ("b", 10, [1.0, 1.0])]
    return spark.createDataFrame([(k, one(i), v, "x") for k, i, v in rows], f"k string, i {kind}, v array<double>, similarity string").repartition(3)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("block", [1000, 1])
def test_similar_pairs_and_nearest_of_any_ids(spark, monkeypatch, kind, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    df = vectors_table(spark, kind)
    one = lambda i: None if i is None else i if kind == "long" else f"id-{i:020}"
    got = {(r.k, r.a, r.b) for r in vectors.similar_pairs(df, "k", "i", "v", 0.9).collect()}
    assert got == {("a", one(LARGE), one(LARGE + 1)), ("a", None, one(LARGE)), ("a", None, one(LARGE + 1)), (None, one(7), one(8))}
    assert vectors.similar_pairs(df.limit(0), "k", "i", "v", 0.9).count() == 0
    centres = spark.createDataFrame([(LARGE + 3, [1.0, 0.0]), (LARGE + 1, [0.0, 1.0]), (LARGE, None)], "c long, w array<double>")
    found = {(r.i, r.c) for r in vectors.nearest(df, centres, "i", "v", "c", "w", 0.9).collect()}
    assert found == {(one(LARGE), LARGE + 3), (one(LARGE + 1), LARGE + 3), (None, LARGE + 3), (one(7), LARGE + 1), (one(8), LARGE + 1)}
    assert vectors.nearest(df, centres.limit(0), "i", "v", "c", "w", 0.9).count() == 0


def test_online_clusters_units_and_centroids_of_odd_rows(spark):
    df = vectors_table(spark)
    got = {(r.k, r.i): r.cluster for r in vectors.track_online(df, ["k"], ["i"], "v", 0.9).collect()}
    assert got == {("a", LARGE): 0, ("a", LARGE + 1): 0, ("a", None): 0, ("a", 5): None, (None, 7): 0, (None, 8): 0, ("b", 9): 0, ("b", 10): 1}
    units = {r.i: r.u for r in df.select("i", vectors.unit(F.col("v")).alias("u")).collect()}
    assert units[5] is None and units[9] == [0.0, 0.0] and units[10] == pytest.approx([0.5**0.5] * 2)
    assert {r.k: r.centroid for r in vectors.centroids(df.where("k is null"), ["k"], "v").collect()} == {None: [0.0, 1.5]}


RUNS = {
    "hysteresis": lambda d: islands.hysteresis(d, ["k"], ["i"], F.col("f")),
    "scanned hysteresis": lambda d: folds.hysteresis(d, ["k"], ["i"], "f"),
    "noise floor": lambda d: folds.noise_floor(d, ["k"], ["i"], "v", "f"),
    "cooldown": lambda d: folds.cooldown(d, ["k"], "i", 2),
    "greedy": lambda d: folds.greedy_apart(d.where("i is not null and v is not null"), ["k"], "i", "v", 2.0),
    "ema": lambda d: folds.ema(d, ["k"], ["i"], "v", 0.5),
    "cv gate": lambda d: rolling.cv_gate(d, ["k"], ["i"], "v"),
    "turns": lambda d: turns.compare_turns(turns.voiced_turns(d.withColumn("c", F.col("v")), ["k"], "i", 2, 1), ["k"], "i", "v", "c", 2, 1, 1),
    "merge": lambda d: islands.merge_intervals(d.withColumn("e", F.col("i") + 1), ["k"], "i", "e"),
    "as of": lambda d: joins.latest_before(d, d, ["k"], "i", "i", "v", "latest"),
    "inside": lambda d: joins.in_intervals(d, d.withColumn("e", F.col("i") + 1), ["k"], "i", "i", "e"),
    "segments": lambda d: folds.merge_segments(d.select("k", F.col("i").cast("double").alias("a"), (F.col("i") + 0.5).alias("b"), "v"), ["k"], "a", "b", "v", "v"),
}


@pytest.mark.parametrize("name", RUNS)
def test_operators_take_odd_rows(spark, name):
    """Null keys are keys; null orders, values and flags have a result; repeated rows don't fail; nothing comes of nothing."""
    rows = [("a", 1, 1.0, True), ("a", 1, 1.0, True), ("a", None, 2.0, False), ("a", 3, None, None), (None, 1, 1.0, True), (None, 2, 2.0, True), (None, 4, 3.0, False), (None, 6, 3.0, True), ("b", 2, math.nan, True)]
    df = spark.createDataFrame(rows, "k string, i long, v double, f boolean")
    got = RUNS[name](df).collect()
    assert any(r.k is None for r in got)
    assert RUNS[name](df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    length = lambda: rng.choice([0.01, 1.0, 1.0, 1.5, 4.0, 300.0, 5000.0, 0.0])
    make = lambda n: [(rng.choice(["a", "b", None]), s := rng.choice([None, float(rng.randint(-200, 4000)), rng.uniform(-200, 4000)]), None if s is None or rng.random() < 0.02 else s + length(), i) for i in range(n)]
    one, two = make(150), make(60)
    got = joins.overlaps(spark.createDataFrame(one, "k string, s double, e double, i int"), spark.createDataFrame(two, "k string, s2 double, e2 double, j int"), ["k"], ("s", "e"), ("s2", "e2"))
    want = sorted((i, j) for k, a, b, i in one for q, c, d, j in two if k == q and None not in (a, b, c, d) and a < b and c < d and a < d and c < b)
    assert sorted((r.i, r.j) for r in got.collect()) == want and want
    empty = spark.createDataFrame([], "k string, s2 double, e2 double, j int")
    assert joins.overlaps(spark.createDataFrame(one, "k string, s double, e double, i int"), empty, ["k"], ("s", "e"), ("s2", "e2")).count() == 0


def test_rollups_of_a_stream_have_the_totals_of_the_table(spark, tmp_path):
    """Rows out of order, repeated, and one that is too late."""
    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([32, 32, 32, 700])
        rows.append((rng.choice("ab"), start + dt.timedelta(milliseconds=at), i, float(i % 17)))
    schema = "k string, ts timestamp, id long, value double"
    arrival = sorted(rows, key=lambda r: (r[1] - start).total_seconds() + rng.uniform(0, 3))
    late = ("a", start, 9999, 1000.0)
    parts = [arrival[i : i + 100] for i in range(0, 400, 100)]
    parts = [[*p, *p[:5]] for p in parts] + [[("z", start + dt.timedelta(hours=1), 10_000, 0.0)], [late], [("z", start + dt.timedelta(hours=2), 10_001, 0.0)]]
    for n, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    def run(df, mode, keys):
        found = {}
        query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp{len(list(tmp_path.iterdir()))}")).foreachBatch(lambda batch, _: found.update({tuple(r[k] for k in keys): r for r in batch.collect()})).start()
        query.processAllAvailable()
        query.stop()
        return {k: r for k, r in found.items() if r["k"] != "z"}

    table, aggs = spark.createDataFrame(rows, schema), rollups.measures("value")
    rowed = lambda df: {(r.k, r.start): r for r in df.collect()}
    want = rowed(rollups.per_window(table, ["k"], "ts", aggs))
    assert run(rollups.once_per_window(read(), ["k"], "ts", ["id"], aggs, delay="5 seconds"), "append", ["k", "start"]) == want
    repeats = [r for p in parts[:4] for r in p]
    assert run(rollups.per_window(read(), ["k"], "ts", aggs, delay="5 seconds"), "update", ["k", "start"]) == rowed(rollups.per_window(spark.createDataFrame(repeats, schema), ["k"], "ts", aggs))
    turns_of = lambda df: rollups.turns_in_time(df, ["k"], "ts", ["id"], aggs, "500 milliseconds", "5 seconds")
    got = run(turns_of(read()), "append", ["k", "start"])
    assert got == rowed(turns_of(table)) and len(got) > 50
    assert sum(r.n for r in got.values()) == 400
