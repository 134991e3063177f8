"""The chain from frames to flags and the decimation of plots, against plain loops over one key's frames."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.operators import detection

LIMITS = {"enrol": 8, "silence": 3, "least": 4, "least_pitched": 2, "least_sustained": 5, "least_seconds": 0.1}


def sounds(f0s, loud, rng, n=512):
    t = np.arange(n) / kernels.RATE
    x = sum(np.sin(2 * np.pi * f * h * t) / h for f in f0s for h in range(1, 7)) if f0s else np.zeros(n)
    return (loud * x + rng.normal(0, 0.002, n)).astype(np.float32).tolist()


def recordings():
    """One voice, silence, another voice, silence, the first one, two at once; and a key that is never enrolled."""
    rng, rows, at = np.random.default_rng(5), [], 0
    for f0s, length in (([125.0], 14), ([], 5), ([250.0], 9), ([], 4), ([125.0], 8), ([], 4), ([110.0, 205.0], 14), ([], 3), ([125.0], 3)):
        for _ in range(length):
            rows.append(("a", at, sounds(f0s, 0.1 * (1 + 0.8 * rng.random()), rng)))
            at += 1
    rows += [(None, i, sounds([180.0], 0.1, rng)) for i in range(6)]
    rows += [("a", 3, rows[3][2]), ("a", None, rows[0][2]), ("b", 0, None), ("b", 1, [0.0] * 7)]
    return rows


def comb_confidence(combs):
    if len(combs) < 2:
        return 0.0
    first = combs[0][1]
    strong = [s for _, s, _ in combs[1:] if s >= 0.45 * first]
    return min(max((strong[0] / (first + 1e-10) - 0.30) / 0.20, 0.0), 1.0) if strong else 0.1


def looped(frames):
    """(rows, flags) of one key's frames (index, samples), one after another."""
    history, smooth, table, voiced = [], [], [], []
    for at, x in frames:
        x = np.array([x], float)
        f = kernels.frame_features(x).iloc[0]
        history = (history + [f["rms"]])[-40:]
        cv = np.std(history) / (np.mean(history) + 1e-10)
        score = int(f["band_ratio"] > 0.45) + int(f["hnr_db"] >= 6) + int(f["flatness"] <= 0.35) + int(len(history) < 12 or 0.15 <= cv <= 2.5)
        a = 0.0
        if score >= 2:
            smooth = (smooth + [comb_confidence(kernels.combs(kernels.magnitudes(x)[0]))])[-5:]
            a = float(np.mean(smooth))
            voiced.append((at, f["f0_hz"], f["centroid"], a))
        table.append([at, score, a, 0.0, False])
    flags, run = [], []
    for v in [*voiced, (None, 0, 0, -1.0)]:
        if v[3] >= 0.75:
            run.append(v)
            continue
        if len(run) >= LIMITS["least_sustained"]:
            flags.append([run[0][0] * 0.032, (run[-1][0] + 1) * 0.032, "A", max(r[3] for r in run)])
        run = []
    profile, later, z_of = voiced[: LIMITS["enrol"]], [], {}
    pitched = [p for _, p, _, _ in profile if p > 0]
    if len(profile) == LIMITS["enrol"] and pitched:
        now, spread = [np.mean(pitched), np.mean([c for _, _, c, _ in profile])], [max(np.std(pitched), 1.0), max(np.std([c for _, _, c, _ in profile]), 10.0)]
        for v in voiced[LIMITS["enrol"] :]:
            if later and v[0] - later[-1][-1][0] <= LIMITS["silence"]:
                later[-1].append(v)
            else:
                later.append([v])
        for turn in later:
            for place, (at, p, c, _) in enumerate(turn, 1):
                if place >= LIMITS["least"]:
                    z_of[at] = 0.65 * (abs(p - now[0]) / spread[0] if p > 0 else 0.0) + 0.35 * abs(c - now[1]) / spread[1]
            heard = [p for _, p, _, _ in turn if p > 0]
            if len(turn) < LIMITS["least"] or len(heard) < LIMITS["least_pitched"]:
                continue
            mean = [np.mean(heard), np.mean([c for _, _, c, _ in turn])]
            z = 0.65 * abs(mean[0] - now[0]) / spread[0] + 0.35 * abs(mean[1] - now[1]) / spread[1]
            sure = min(max(z / 8, 0), 0.49) if z < 4 else min(max(0.5 + (z - 4) / 6, 0.5), 1.0)
            if sure >= 0.75:
                flags.append([turn[0][0] * 0.032, (turn[-1][0] + 1) * 0.032, "B", sure])
            elif z < 2:
                now = [0.95 * n + 0.05 * m for n, m in zip(now, mean)]
    merged = []
    for start, end, scenario, sure in sorted(f for f in flags if f[1] - f[0] >= LIMITS["least_seconds"] and f[3] >= 0.75):
        if merged and start <= merged[-1][1] + 0.5:
            last = merged[-1]
            merged[-1] = [last[0], max(last[1], end), scenario if scenario == last[2] else "AB", max(last[3], sure)]
        else:
            merged.append([start, end, scenario, sure])
    for row in table:
        row[3] = z_of.get(row[0], 0.0)
        row[4] = any(s <= row[0] * 0.032 < e for s, e, _, _ in merged)
    return table, merged


def test_the_chain_is_that_of_a_loop(spark):
    rows = recordings()
    frames = spark.createDataFrame(rows, "who string, at int, samples array<float>").repartition(5)
    table, flags = detection.detect(frames, ["who"], "at", **LIMITS)
    got, found = table.collect(), flags.collect()
    assert len(got) == 64 + 6 and {r["who"] for r in got} == {"a", None}
    seen = set()
    for who in ("a", None):
        mine = {r[1]: r[2] for r in rows if r[0] == who and r[1] is not None}
        want, merged = looped(sorted(mine.items()))
        have = sorted((r["at"], r["score"], r["a_confidence"], r["z"], r["flagged"]) for r in got if r["who"] == who)
        for x, y in zip(have, want, strict=True):
            assert x[0] == y[0] and x[1] == y[1] and x[4] == y[4] and np.allclose(x[2:4], y[2:4], atol=1e-6), (x, y)
        own = sorted((f["start_s"], f["end_s"], f["scenario"], f["confidence"], f["severity"]) for f in found if f["who"] == who)
        for x, y in zip(own, merged, strict=True):
            assert np.allclose([x[0], x[1], x[3]], [y[0], y[1], y[3]], atol=1e-6) and x[2] == y[2] and x[4] == ("HIGH" if y[3] >= 0.9 else "MEDIUM")
            seen.add(x[2])
    assert seen & {"B", "AB"} and seen & {"A", "AB"}, seen
    hz = {r["at"]: r["display_hz"] for r in got if r["who"] == "a"}
    assert abs(hz[4] - 125) < 5 and abs(hz[20] - 250) < 8 and hz[15] == 0.0


def test_nothing_to_detect(spark):
    empty = spark.createDataFrame([], "who string, at int, samples array<float>")
    table, flags = detection.detect(empty, ["who"], "at")
    assert table.count() == 0 and flags.count() == 0


@pytest.mark.parametrize("pixels", [1, 7, 50])
def test_decimation_keeps_every_peak(spark, pixels):
    rng = random.Random(pixels)
    rows = [(k, i * (3 if k == "x" else 1) - 40, None if rng.random() < 0.1 else rng.random()) for k in ("x", "y", None) for i in range(rng.randint(1, 90))]
    rows += [("x", None, 9.0), ("y", 2**40, 0.5), *rows[:5]]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(4)
    got = {(r["k"], r["pixel"]): tuple(r)[2:] for r in detection.decimated(df, ["k"], "i", {"v": F.col("v")}, pixels).collect()}
    want = {}
    pdf = pd.DataFrame([(repr(k), i, v) for k, i, v in rows if i is not None], columns=["k", "i", "v"])
    for k, part in pdf.groupby("k"):
        low, span = int(part["i"].min()), int(part["i"].max()) - int(part["i"].min()) + 1
        for i, v in zip(part["i"], part["v"]):
            want.setdefault((eval(k), (int(i) - low) * pixels // span), []).append((int(i), v))
    assert got.keys() == want.keys()
    for key, held in want.items():
        values = [v for _, v in held if not math.isnan(v)]
        assert got[key] == (min(i for i, _ in held), max(i for i, _ in held), len(held), min(values, default=None), max(values, default=None))
