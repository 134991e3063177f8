"""Mergeable scans against plain loops: summaries at any cuts, and keys that are spread over many parts."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import folds, scans

PROGRAMS = {
    "hysteresis": (lambda: scans.Hysteresis(3, 5), lambda rng, i: (rng.random() < (0.9 if i // 20 % 2 else 0.2) if rng.random() < 0.95 else None,)),
    "cooldown": (lambda: scans.Cooldown(10), lambda rng, i: (i * 2 + rng.choice([0, 1]) if rng.random() < 0.9 else None,)),
    "dense cooldown": (lambda: scans.Cooldown(10), lambda rng, i: (i // 7 * 0.5,)),
    "floor": (lambda: scans.Floor(lambda: folds.NoiseFloor(calibrate=9, alpha=0.05)), lambda rng, i: (rng.random() if rng.random() < 0.9 else None, rng.choice([True, False, None]))),
    "groups": (lambda: scans.Groups(3.0), lambda rng, i: (float(4 * i + rng.randint(0, 2)) if rng.random() < 0.95 else None, float(4 * i + rng.randint(1, 5)))),
}


def plain(program, rows):
    state, out = program.fresh(), []
    for row in rows:
        state, found = program.step(state, *row)
        out.append(found)
    return state, out


@pytest.mark.parametrize("name", PROGRAMS)
def test_summaries_lead_where_the_rows_lead(name):
    make, row = PROGRAMS[name]
    for seed in range(200):
        rng, program = random.Random(seed), make()
        rows = [row(rng, i) for i in range(rng.randint(0, 120))]
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 6)))
        state = program.fresh()
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            block = program.summary()
            for r in rows[a:b]:
                block.push(*r)
            state = program.after(block.packed(), state)
        want = plain(program, rows)[0]
        if name == "floor":
            assert state[0] == want[0] and state[1] == pytest.approx(want[1], rel=1e-12)
        else:
            assert state == want


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small parts stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, keys=("long", "a", "b", None)):
    rng, rows = random.Random(3), []
    for key in keys:
        for i in range(3000 if key == "long" else rng.randint(0, 40)):
            rows.append((key, 2 * i + rng.choice([0, 1]), rng.random() if rng.random() < 0.95 else None, rng.random() < 0.6, {"x": i}))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i long, v double, f boolean, other map<string, int>").repartition(5), rows


def by_key(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r[1]):
        found.setdefault(r[0], []).append(r)
    return found


def test_scans_of_a_long_key(spark):
    """The long key is in many parts, each of which begins in the middle of it; a null key is a key."""
    df, rows = table(spark)
    split = df.repartitionByRange("k", "i").withColumn("p", F.spark_partition_id()).where("k = 'long'").select("p").distinct().count()
    assert split > 1
    calm = {(r.k, r.i): (r.active, r.other["x"]) for r in folds.hysteresis(df, ["k"], ["i"], "f", 3, 5, pass_on=("other",)).collect()}
    fired = {(r.k, r.i) for r in folds.cooldown(df, ["k"], "i", 7).collect()}
    level = {(r.k, r.i): r.floor for r in folds.noise_floor(df, ["k"], ["i"], "v", "f", calibrate=20).collect()}
    for key, mine in by_key(rows).items():
        on = plain(scans.Hysteresis(3, 5), [(r[3],) for r in mine])[1]
        assert [calm[key, r[1]] for r in mine] == [(o[0], r[4]["x"]) for o, r in zip(on, mine)]
        fires = plain(scans.Cooldown(7), [(r[1],) for r in mine])[1]
        assert [(key, r[1]) in fired for r in mine] == [f is not None for f in fires]
        floors = plain(scans.Floor(lambda: folds.NoiseFloor(calibrate=20)), [(r[2], r[3]) for r in mine])[1]
        assert [level[key, r[1]] for r in mine] == pytest.approx([f[0] for f in floors], rel=1e-12)
    assert len(calm) == len(level) == len(rows)
    for run in (lambda d: folds.hysteresis(d, ["k"], ["i"], "f"), lambda d: folds.cooldown(d, ["k"], "i", 7), lambda d: folds.noise_floor(d, ["k"], ["i"], "v", "f")):
        assert run(df.limit(0)).count() == 0


def test_joined_segments_of_a_long_key(spark):
    rng, rows = random.Random(8), []
    for key in ("long", "x", None):
        at = 0.0
        for _ in range(1500 if key == "long" else 9):
            at += rng.choice([0.05, 0.1, 0.3])
            rows.append((key, at, at + rng.choice([0.05, 0.4]), rng.random(), rng.random()))
            at = rows[-1][2]
    got = sorted(map(tuple, folds.merge_segments(spark.createDataFrame(rows, "k string, a double, b double, x double, f double").repartition(4), ["k"], "a", "b", "x", "f").collect()), key=str)
    want = []
    for key in ("long", "x", None):
        mine, held = [r for r in rows if r[0] == key], []
        steps = lambda a, b: max(1, round((b - a) / 0.032))
        for _, a, b, x, _ in mine:
            if held and a - held[-1][1] < 0.150:
                h = held[-1]
                n, m = steps(h[0], h[1]), steps(a, b)
                held[-1] = [h[0], b, (h[2] * n + x * m) / (n + m), h[3] + 1]
            else:
                held.append([a, b, x, 1])
        want += [(key, max(0.0, a - 0.080), b + 0.080, x, n, x < 5 * mine[-1][4]) for a, b, x, n in held]
    assert [r[0] for r in got] == [r[0] for r in sorted(want, key=str)]
    assert all(g == pytest.approx(w) for g, w in zip(got, sorted(want, key=str)))
