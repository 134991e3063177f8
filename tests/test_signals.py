"""Kernels, folds, turns, vectors, sources and live sessions against naive versions written out step by step."""

import io
import math
import random
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.operators import folds, histograms, joins, rules, turns, vectors
from cadenza.sources import wav
from cadenza.streaming import session


def naive_r(x):
    r = np.correlate(x, x, "full")[len(x) - 1 :]
    return r / (r[0] + 1e-10)


def naive_dips(x):
    n = len(x)
    low, high = 40, min(266, n // 2)
    if low >= high:
        return 0.0
    r = np.correlate(x, x, "full")[n - 1 :]
    curve, run = [1.0], 0.0
    for lag in range(1, high + 1):
        d = 2 * (r[0] - r[lag])
        run += d
        curve.append(d * lag / (run + 1e-10))
    for lag in range(low, high):
        if curve[lag] < 0.2:
            while lag + 1 < high and curve[lag + 1] < curve[lag]:
                lag += 1
            return 16000 / lag
    lag = min(range(low, high), key=lambda t: curve[t])
    return 16000 / lag if curve[lag] < 0.85 else 0.0


def voice(f0, n, rng, noise=0.01):
    t = np.arange(n) / 16000
    return sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 6)) * 0.2 + rng.normal(0, noise, n)


def test_frame_features_against_formulas():
    rng = np.random.default_rng(1)
    rows = [voice(f, 512, rng) for f in (90, 140, 230, 390)] + [rng.normal(0, 0.2, 512), rng.normal(0, 0.1, 512) + 0.5, np.zeros(512)]
    got = kernels.frame_features(np.stack(rows))
    f = np.fft.rfftfreq(512, 1 / 16000)
    for i, x in enumerate(rows):
        m = np.abs(np.fft.rfft(x * np.hanning(512)))
        voiced, speech = (f >= 80) & (f <= 3400), (f >= 200) & (f <= 3400)
        r = naive_r(x)
        peak = min(max(r[32:200].max(), 0), 1 - 1e-10)
        assert got.hnr_db[i] == pytest.approx(10 * math.log10(peak / (1 - peak + 1e-10) + 1e-10), abs=1e-6)
        best = int(np.argmax(r[40:200])) + 40
        assert got.f0_hz[i] == pytest.approx(16000 / best if r[best] >= 0.3 else 0.0)
        b = m[voiced] + 1e-10
        assert got.flatness[i] == pytest.approx(min(1, math.exp(np.log(b + 1e-10).mean()) / (b.mean() + 1e-10)))
        assert got.full_flatness[i] == pytest.approx(math.exp(np.log(m + 1e-10).mean()) / (m + 1e-10).mean())
        p = (m + 1e-10) ** 2
        assert got.speech_ratio[i] == pytest.approx(p[speech].sum() / (p.sum() + 1e-10)) and got.peak_ratio[i] == pytest.approx(p[speech].max() / (p[speech].sum() + 1e-10))
        c = np.cumsum(m**2)
        assert got.rolloff[i] == f[min(np.searchsorted(c, 0.85 * (c[-1] + 1e-10)), 256)]
        bands = []
        edges = 700 * (10 ** (np.linspace(2595 * math.log10(1 + 80 / 700), 2595 * math.log10(1 + 4000 / 700), 14) / 2595) - 1)
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            bands.append(sum(v * v * ((h - lo) / (mid - lo) if h <= mid else (hi - h) / (hi - mid)) for v, h in zip(m, f) if lo <= h <= hi))
        logs = np.log(np.array(bands) + 1e-10)
        for k, name in ((1, "mfcc1"), (2, "mfcc2")):
            assert got[name][i] == pytest.approx(sum(v * math.cos(math.pi * k * (j + 0.5) / 12) for j, v in enumerate(logs)), abs=1e-5)


def test_pitch_by_dips_and_segment_vectors():
    rng = np.random.default_rng(2)
    for n in (60, 300, 700, 2048):
        x = np.stack([voice(f, n, rng, noise) for f in (70, 120, 210, 333) for noise in (0.0, 0.05, 0.5)] + [rng.normal(0, 1, n), np.zeros(n)])
        assert kernels.dip_pitch(x) == pytest.approx([naive_dips(row) for row in x])
    samples = np.concatenate([voice(150, 3000, rng), rng.normal(0, 0.05, 1500)])
    got = kernels.segment_vector(samples)
    f0s = []
    for i in range(8):
        a, b = naive_dips(samples[i * 512 : i * 512 + 2048]), naive_dips(samples[i * 512 + 256 : i * 512 + 2304])
        f0s.append((a + b) / 2 if a and b else a or b)
    assert got[26] == pytest.approx(np.median([x for x in f0s if x > 0])) and len(got) == 31
    assert got[:13] == pytest.approx(np.mean([kernels.cepstrum(kernels.magnitudes(samples[None, i * 512 : i * 512 + 512]) ** 2, kernels.SEGMENT_MEL, range(13))[0] for i in range(8)], 0))
    assert not kernels.segment_vector(samples[:500]).any()


def test_voice_streams():
    rng = np.random.default_rng(3)
    samples = np.concatenate([voice(180, 8000, rng), np.zeros(4000)])
    pitch, spread = kernels.voice_streams(samples)
    assert np.linalg.norm(pitch) == pytest.approx(1) and abs(60 + (pitch.argmax() + 0.5) * 4.25 - 180) < 5 and (spread > 0).all() and len(spread) == 10
    assert not kernels.voice_streams(samples[:600])[0].any() and (kernels.voice_streams(np.zeros(9000))[1] == 1).all()


def test_histogram_of_numpy_and_of_spark_agree(spark):
    values = [60.0, 61.0, 75.0, 75.5, 180.0, 181.0, 399.9, 400.0, 20.0, 500.0]
    got = {r.bin: r.share for r in histograms.smoothed(spark.createDataFrame([(1, v) for v in values], "k int, v double"), ["k"], F.col("v"), 80, 60.0, 400.0, 2.0).collect()}
    want = kernels.pitch_histogram(np.array(values))
    assert [got.get(i + 1, 0.0) for i in range(80)] == pytest.approx(want.tolist())


def test_kernels_in_spark(spark):
    rng = np.random.default_rng(4)
    x = voice(120, 4096, rng) + voice(200, 4096, rng)
    recordings = spark.createDataFrame([("a", x.tolist())], "recording_id string, samples array<double>")
    frames = wav.frames_of(recordings)
    made = kernels.with_features(frames, ["recording_id", "frame_idx"], with_combs=True)
    assert made.count() == 8 and all(r.combs for r in made.collect())
    confidence = made.select(rules.comb_confidence(F.col("combs")).alias("c")).collect()
    assert all(0 <= r.c <= 1 for r in confidence)
    assert kernels.with_vectors(recordings, ["recording_id"]).first().features == pytest.approx(kernels.segment_vector(x).tolist())
    assert kernels.with_streams(recordings, ["recording_id"]).first().f0_vec == pytest.approx(kernels.voice_streams(x)[0].tolist())


def test_comb_confidence(spark):
    cases = [([], 0.0), ([1.0], 0.0), ([1.0, 0.4], 0.1), ([1.0, 0.46], 0.8), ([1.0, 0.9], 1.0), (None, 0.0)]
    df = spark.createDataFrame([(i, None if c is None else [(x,) for x in c]) for i, (c, _) in enumerate(cases)], "i int, combs array<struct<score: double>>")
    assert [r.c for r in df.select("i", rules.comb_confidence(F.col("combs")).alias("c")).orderBy("i").collect()] == pytest.approx([w for _, w in cases], abs=1e-6)


def test_folds_in_linear_time_and_against_loops(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.random(), rng.random() < 0.3) for k in (None, 1, 2**60) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long, v double, s boolean").repartition(5)
    floors, emas, fires = {}, {}, {}
    for key in (None, 1, 2**60):
        seen, level, average, fired = [], 0.005, None, None
        for _, i, v, s in [r for r in rows if r[0] == key]:
            if len(seen) < 20:
                seen.append(v)
                if len(seen) == 20:
                    level = max(float(np.percentile(seen, 20)), 1e-5)
            elif not s:
                level = max(1e-5, level * 0.998 + v * 0.002)
            floors[key, i] = level
            average = v if average is None else average * 0.9 + v * 0.1
            if fired is None or i - fired >= 7:
                fired = i
                fires[key, i] = True
        emas[key] = average
    assert {(r.k, r.i): r.floor for r in folds.noise_floor(df, ["k"], ["i"], "v", "s", calibrate=20).collect()} == pytest.approx(floors)
    assert {r.k: r.ema for r in folds.ema(df, ["k"], ["i"], "v", 0.1).collect()} == pytest.approx(emas)
    assert {(r.k, r.i): True for r in folds.cooldown(df, ["k"], "i", 7).collect()} == fires
    kept = {}
    for key in (None, 1, 2**60):
        for v, i in sorted([(v, i) for k, i, v, _ in rows if k == key], key=lambda x: (-x[0], x[1])):
            if all(abs(i - j) >= 4 for k, j in kept if k == key):
                kept[key, i] = v
    assert {(r.k, r.i): r.v for r in folds.greedy_apart(df, ["k"], "i", "v", 4).collect()} == kept
    long = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.rand(1).alias("v"))
    assert folds.cooldown(long, ["k"], "i", 10).count() == 10_000 and folds.greedy_apart(long, ["k"], "i", "v", 3).count() > 20_000


def test_turns_against_a_loop(spark):
    rng, rows, want = random.Random(6), [], {}
    for key in range(6):
        index, profile, seen, turn, segment, last = 0, None, [], 0, [], None
        shift = rng.choice([0, 60])

        def close():
            if segment:
                f0 = [a for _, a, _ in segment if a > 0]
                z = None
                before = list(profile[:2])
                if len(segment) >= 15 and len(f0) >= 5:
                    z = 0.65 * abs(np.mean(f0) - profile[0]) / profile[2] + 0.35 * abs(np.mean([c for *_, c in segment]) - profile[1]) / profile[3]
                    if rules.plain_z_confidence(z) < 0.75 and z < 2:
                        profile[0], profile[1] = 0.95 * profile[0] + 0.05 * np.mean(f0), 0.95 * profile[1] + 0.05 * np.mean([c for *_, c in segment])
                want[key, turn] = (segment[0][0], segment[-1][0] + 1, z, *before)

        for n in range(260):
            index += 1 if rng.random() < 0.93 else rng.randint(5, 20)
            moved = shift if n > 150 else 0
            f0, centroid = rng.choice([0.0, 120 + moved + rng.random() * 8, 124.0 + moved]), 900 + rng.random() * 100
            rows.append((key, index, f0, centroid))
            if len(seen) < 60:
                seen.append((f0, centroid))
                if len(seen) == 60:
                    p = [a for a, _ in seen if a > 0]
                    profile = [np.mean(p), np.mean([c for _, c in seen]), max(np.std(p), 1.0), max(np.std([c for _, c in seen]), 10.0)]
                continue
            if last is None or index - last > 10:
                close()
                turn, segment = turn + 1, []
            segment.append((index, f0, centroid))
            last = index
        close()
    made = turns.voiced_turns(spark.createDataFrame(rows, "k int, i long, f0_hz double, centroid double"), ["k"], "i")
    compared = turns.compare_turns(made, ["k"], "i")
    got = {(r.k, r.turn): (r.start_frame, r.end_frame, r.z, r.reference_f0, r.reference_centroid) for r in compared.collect()}
    assert got.keys() == want.keys() and compared.where("flagged").count() > 0
    for key, row in want.items():
        assert got[key][:2] == row[:2] and (got[key][2] is None) == (row[2] is None)
        assert got[key][3:] == pytest.approx(row[3:]) and (row[2] is None or got[key][2] == pytest.approx(row[2]))
    assert turns.frame_distances(made, compared, ["k"], "i").count() == len(rows)


def test_intervals_may_overlap(spark):
    points = spark.createDataFrame([(1, float(t)) for t in range(12)] + [(2, 3.0)], "k int, t double")
    intervals = spark.createDataFrame([(1, 1.0, 6.0), (1, 2.0, 3.0), (1, 8.0, 8.0), (1, 9.0, 10.0)], "k int, a double, b double")
    got = {(r.k, r.t) for r in joins.in_intervals(points, intervals, ["k"], "t", "a", "b").collect() if r.inside}
    assert got == {(1, float(t)) for t in (1, 2, 3, 4, 5, 9)}


def test_similar_pairs_and_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6))
    rows = [(i, int(i % 3 > 0), v.tolist()) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (i % 3 > 0) == (j % 3 > 0) and u[i] @ u[j] >= 0.4}
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    for block in (1000, 7):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = [(r.a, r.b) for r in vectors.similar_pairs(df, "label", "id", "v", 0.4).collect()]
        assert len(got) == len(want) and set(got) == want
    centres = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(20, 45)], "c long, w array<double>")
    best = {i: 20 + int((u[i] @ u[20:45].T).argmax()) for i in range(120)}
    for limit in (100, 3):
        monkeypatch.setattr(vectors, "MAX_SENT_CENTRES", limit)
        assert {r.id: r.c for r in vectors.nearest(df, centres, "id", "v", "c", "w", -1.0).collect()} == best


def test_clustering_against_naive_versions(spark):
    rng = random.Random(8)
    nodes, pairs, want = [], [], {}
    for key in range(8):
        n = rng.randint(2, 14)
        score = {(i, j): (round(rng.random(), 3), rng.choice([0.81, 0.92, 0.6])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.7}
        nodes += [(key, i) for i in range(n)]
        pairs += [(key, i, j, s, t) for (i, j), (s, t) in score.items()]
        groups = [[i] for i in range(n)]
        while True:
            found = []
            for a in range(len(groups)):
                for b in range(a + 1, len(groups)):
                    between = [score[tuple(sorted((i, j)))] for i in groups[a] for j in groups[b] if tuple(sorted((i, j))) in score]
                    if between:
                        s, t = max(between, key=lambda x: x[0])
                        found.append((s - t, a, b))
            if not found or max(found)[0] < 0:
                break
            _, a, b = max(found, key=lambda x: (x[0], -x[1], -x[2]))
            groups[a] += groups.pop(b)
        for number, g in enumerate(sorted(groups, key=min)):
            want.update({(key, i): number for i in g})
    got = vectors.agglomerate(spark.createDataFrame(pairs, "r int, a int, b int, similarity double, threshold double"), spark.createDataFrame(nodes, "r int, node int"), "r")
    assert {(r.r, r.node): r.cluster for r in got.collect()} == want
    x, rows, want = np.random.default_rng(9).normal(size=(200, 3)), [], {}
    centres: dict = {}
    for i, v in enumerate(x):
        key = i % 2
        rows.append((key, i, v.tolist()))
        v, own = v / np.linalg.norm(v), centres.setdefault(key, [])
        near = [c @ v for c, _ in own]
        if near and max(near) >= 0.8:
            at = int(np.argmax(near))
            c, n = own[at]
            c = (c * n + v) / (n + 1)
            own[at] = (c / np.linalg.norm(c), n + 1)
        else:
            own.append((v, 1))
            at = len(own) - 1
        want[i] = at
    assert {r.i: r.cluster for r in vectors.track_online(spark.createDataFrame(rows, "k int, i int, v array<double>"), ["k"], ["i"], "v", 0.8).collect()} == want


def test_verified_notes_and_nobody_enrolled(spark):
    schema = "name string, f0_vec array<double>, var_vec array<double>"
    enrolled = spark.createDataFrame([("e", [1.0, 0.0], [4.0] * 10), ("silent", [0.0, 0.0], [1e-8] * 10)], schema)
    tests = spark.createDataFrame([("same", [2.0, 0.0], [4.0] * 10), ("shifted", [0.0, 1.0], [4.0] * 10), ("other", [0.0, 1.0], [400.0] * 10)], schema)
    got = {r.name: r for r in vectors.verified(tests, enrolled, "name").collect()}
    assert (got["same"].verdict, got["same"].similarity, got["same"].confidence, got["same"].note) == ("MATCH", 1.0, 1.0, "")
    assert got["shifted"].similarity == pytest.approx(0.35, abs=1e-4) and got["other"].verdict == "MISMATCH" and got["other"].note == "unknown speaker"
    with pytest.raises(ValueError, match="nobody"):
        vectors.verified(tests, enrolled.where("name = 'silent'"), "name")


def pcm(samples, width, channels, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples.tobytes())
    return out.getvalue()


def test_wav_modes_and_resampling(spark, tmp_path):
    stereo = np.array([[1000, 3000], [-2000, 0]], "<i2")
    assert wav.decode_wav(pcm(stereo, 2, 2, 16000)) == pytest.approx([2000 / 32768, -1000 / 32768])
    assert wav.decode_wav(pcm(np.array([-128, 64], "i1"), 1, 1, 16000), mode="int8") == pytest.approx([-1, 0.5])
    assert len(wav.decode_wav(pcm(np.zeros((4, 3), "<i2"), 2, 3, 16000), mode="int16")) == 12
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    up = wav.resample(tone, 8000, 16000)
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert len(up) == 16000 and np.abs(up - want)[200:-200].max() < 2e-3
    down = wav.resample(np.sin(2 * np.pi * 440 * np.arange(44100) / 44100), 44100, 16000)
    assert len(down) == 16000 and np.abs(down - want)[200:-200].max() < 2e-3
    assert np.abs(wav.resample(np.sin(2 * np.pi * 7000 * np.arange(16000) / 16000), 16000, 8000))[100:-100].max() < 0.02
    low = np.frombuffer(wav.clip_bytes(np.array([-1.5, -1.00001, 1.5]))[44:], "<i2")
    assert low.tolist() == [-32768, -32767, 32767] and np.frombuffer(wav.encode_wav(np.array([-1.5]))[44:], "<i2").tolist() == [-32767]
    assert wav.mono(np.array([[1, 3], [2, 4], [5, 7]], np.int16)) == pytest.approx(np.array([2, 3, 6]) / 32768)
    (tmp_path / "x.txt").write_text("no")
    with pytest.raises(FileNotFoundError):
        wav.read_recordings(spark, str(tmp_path))
    name = spark.range(1).select(wav.proof_name(F.lit(3), F.lit("GHOST_VOICE"), F.lit(12.34))).first()[0]
    assert name == "003_GHOST_VOICE_12.3s.wav"


SCHEMA = "session_id string, chunk_idx long, speech_prob double, samples array<double>, embedding array<double>, lip_active boolean, enrolled array<double>, control string"


def live(sessions=3, n=300):
    rng, rows = np.random.default_rng(2), []
    for s in range(sessions):
        enrolled = rng.normal(size=8)
        enrolled /= np.linalg.norm(enrolled)
        other = rng.normal(size=8)
        other -= (other @ enrolled) * enrolled
        stranger = 0.25 * enrolled + 0.97 * other / np.linalg.norm(other)  # most heard in the last session
        for i in range(n):
            v = (stranger if s == 2 else enrolled if i % 80 < 40 else rng.normal(size=8)).tolist() if i % 10 == 5 and i > 20 else None
            lips = None if rng.random() < 0.6 else bool(rng.random() < 0.3)
            control = "reset" if s == 1 and i == 150 else "summary" if i == n - 1 else None
            rows.append((f"s{s}", i, float(rng.random() * 0.5 + 0.3), rng.normal(0, 0.1, 16).tolist(), v, lips, enrolled.tolist() if i == 3 else None, control))
    return rows


def independent(rows):
    """One session after the other, with the rules written out anew."""
    out = []
    for key in sorted({r[0] for r in rows}):
        enrolled, lips, run, active, clusters, score, quiet, scores, chunks, speech, heard = None, False, 0, False, [], 0.0, {}, [], 0, 0, []
        for _, i, probability, samples, embedding, given, own, control in sorted(r for r in rows if r[0] == key):
            if control == "reset":
                lips, run, active, clusters, score, quiet, scores, chunks, speech, heard = False, 0, False, [], 0.0, {}, [], 0, 0, []
            heard += samples
            enrolled = np.array(own) if own is not None else enrolled
            loud = probability >= 0.45
            run = max(run, 0) + 1 if loud else min(run, 0) - 1
            active = True if run >= 3 else False if run <= -10 else active
            speech += active
            if embedding is not None and enrolled is not None:
                v = np.array(embedding) / np.linalg.norm(embedding)
                near = [c @ v for c, _ in clusters]
                if near and max(near) >= 0.75:
                    at = int(np.argmax(near))
                    c = (clusters[at][0] * clusters[at][1] + v) / (clusters[at][1] + 1)
                    clusters[at] = (c / np.linalg.norm(c), clusters[at][1] + 1)
                else:
                    clusters.append((v, 1))
                score = float(max(clusters, key=lambda c: c[1])[0] @ enrolled / np.linalg.norm(enrolled))
                scores.append(score)
            lips = lips if given is None else given
            chunks += 1
            quiet = {k: n - 1 for k, n in quiet.items() if n > 1}
            kind = None
            if enrolled is not None and active:
                if not lips and 0.05 <= score < 0.4:
                    kind, sure = "IMPERSONATION", min(1, (0.4 - score) / 0.4 + 0.3)
                elif not lips and score >= 0.72:
                    kind, sure = "GHOST_VOICE", min(1, score)
                elif len(clusters) >= 2:
                    kind, sure = "EXTRA_SPEAKER", min(1, 0.5 + 0.2 * (len(clusters) - 1))
                elif 0.05 <= score < 0.4:
                    kind, sure = "VOICE_MISMATCH", min(1, (0.4 - score) / 0.4)
            if kind and kind not in quiet:
                quiet[kind] = {"IMPERSONATION": 100, "GHOST_VOICE": 100, "EXTRA_SPEAKER": 150, "VOICE_MISMATCH": 80}[kind]
                out.append((key, i, kind, round(sure, 3), round(score, 4), len(clusters), lips, len(heard)))
            if control == "summary":
                out.append((key, i, "SUMMARY", chunks, round(speech * 0.032, 2), round(float(np.mean(scores)), 4), round(min(scores), 4)))
    return out


def plain(r):
    if r.event_type == "SUMMARY":
        return r.session_id, r.chunk_idx, "SUMMARY", r.total_chunks_processed, r.total_speech_s, r.verify_score_mean, r.verify_score_min
    return r.session_id, r.chunk_idx, r.event_type, r.confidence, r.verify_score, r.n_speakers, r.lip_active, (len(r.audio_proof) - 44) // 2


def test_sessions_in_batch_and_as_a_stream_against_an_independent_loop(spark, tmp_path):
    """The stream gets chunks out of order, within and across micro-batches, and some twice."""
    rows = live()
    want = independent(rows)
    assert len({w[2] for w in want}) >= 4
    got = sorted((plain(r) for r in session.session_events_batch(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda x: x[:3])
    assert got == sorted(want, key=lambda x: x[:3])
    rng = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 30))
    parts = [mixed[i : i + 180] for i in range(0, len(mixed), 180)]
    for n, part in enumerate(parts):
        spark.createDataFrame(part + part[:3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = session.session_events(stream).writeStream.format("memory").queryName("live_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((plain(r) for r in spark.table("live_out").collect()), key=lambda x: x[:3]) == got


def test_voiced_samples_are_embedded_when_there_are_enough():
    made = []

    def embed(x):
        made.append(len(x))
        return np.array([1.0, 0.0])

    s = session.Session(embed=embed)
    for i in range(140):
        s.push(0.9, None, False, np.array([1.0, 0.0]), np.zeros(512))
    assert made == [63 * 512, 63 * 512] and s.score == 1.0 and len(s.proof()) == 44 + 2 * min(session.EVIDENCE, 140 * 512)
    again = session.Session(s.state(), embed=embed)
    assert again.state()[:11] == s.state()[:11] and again.voiced_n == 12 * 512


def test_rules_and_sessions_have_one_decision_chain(spark):
    cases = [(a, l, s, n) for a in (True, False) for l in (True, False) for s in (0.0, 0.04, 0.05, 0.2, 0.4, 0.5, 0.72, 0.9) for n in (0, 1, 2, 5)]
    df = spark.createDataFrame(cases, "a boolean, l boolean, s double, n int")
    kind = rules.fusion_decision(F.col("a"), F.col("l"), F.col("s"), F.col("n"))
    for r in df.select("*", kind.alias("kind")).select("*", rules.event_confidence(F.col("kind"), F.col("l"), F.col("s"), F.col("n")).alias("c")).collect():
        found = session.decide(r.a, r.l, r.s, r.n)
        assert (found is None) == (r.kind is None) and (found is None or (found[0] == r.kind and found[1] == pytest.approx(r.c)))


def test_chunks(spark):
    r = spark.createDataFrame([("a", [float(i) for i in range(25)]), ("b", [1.0, 2.0])], "recording_id string, samples array<double>")
    got = sorted((x.recording_id, x.chunk, len(x.samples)) for x in wav.chunks_of(r, 10 / 16000).collect())
    assert got == [("a", 0, 10), ("a", 1, 10), ("b", 0, 2)]
    got = sorted((x.recording_id, x.chunk, len(x.samples)) for x in wav.chunks_of(r, 10 / 16000, 5 / 16000).collect())
    assert got == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 2)]
    assert pd.DataFrame(wav.rechunked(spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, []), ("a", 2, [3.0, 4.0, 5.0])], "recording_id string, block_idx int, samples array<double>"), 2).collect(), columns=["r", "f", "s"]).sort_values("f").s.tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_spectra_of_a_batch_are_made_in_pieces(spark):
    """A part's 2,000 frames come as one batch of Spark's; no spectra of the whole batch are made, and each is its own frame's."""
    at_once, magnitudes = spark.sparkContext.accumulator(0), kernels.magnitudes
    frames = spark.range(2000).coalesce(1).selectExpr("id", "transform(sequence(0, 511), j -> sin((id % 97 + 1) * j / 50.0D)) AS samples")

    def seen(x):
        at_once.add(1 << 20 if len(x) > 512 else len(x))
        return magnitudes(x)

    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(kernels, "magnitudes", seen)
        rows = kernels.with_spectra(frames, ["id"]).collect()
    assert at_once.value == 2000 and [r.id for r in rows] == list(range(2000))
    for r in rows[::111]:
        x = np.sin((r.id % 97 + 1) * np.arange(512) / 50.0)
        assert r.magnitude == pytest.approx(magnitudes(x[None])[0].tolist())


def test_samples_leave_a_task_in_pieces(spark, monkeypatch):
    """Waves and their features are made for a bounded number of samples at once, in as many parts as shuffles have, whatever the size of the tones."""
    from cadenza.plans import voices

    monkeypatch.setattr(voices, "MADE", 2048)
    monkeypatch.setattr(kernels, "ROWS", 3, raising=False)
    tones = spark.createDataFrame([(u, [(i, 20.0 * u + i) for i in range(4)]) for u in range(50)], "user_id long, _t array<struct<idx: long, value: double>>")
    made = voices._sounded(tones, ["user_id"], 512)
    longest = made.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    assert made.rdd.getNumPartitions() >= 4
    assert sum(r.n for r in longest.collect()) == 50
    largest = spark.sparkContext.accumulator(0)
    magnitudes = kernels.magnitudes

    def seen(x):
        largest.add(len(x) > 3)
        return magnitudes(x)

    monkeypatch.setattr(kernels, "magnitudes", seen)
    rows = made.collect()
    got = {r.user_id: r.magnitude for r in kernels.with_spectra(made, ["user_id"]).collect()}
    assert largest.value == 0
    for r in rows:
        j = np.arange(512)
        x = (((j * 7919 + r.user_id * 104729) % 1000) / 1000.0 - 0.5) * 0.02
        for i in range(4):
            x = x + np.sin(voices.CIRCLE * (100 + 20.0 * r.user_id + i) * j / 16000.0) * (0.05 + 0.02 * i)
        assert np.array_equal(x, r.samples)
        assert got[r.user_id] == pytest.approx(magnitudes(x[None])[0].tolist())
    vectors_of = {r.user_id: r.features for r in kernels.with_vectors(made, ["user_id"]).collect()}
    streams = {r.user_id: (r.f0_vec, r.var_vec) for r in kernels.with_streams(made, ["user_id"]).collect()}
    monkeypatch.setattr(kernels, "magnitudes", magnitudes)
    for r in rows[::7]:
        assert vectors_of[r.user_id] == pytest.approx(kernels.segment_vector(np.array(r.samples)).tolist())
        assert all(a == pytest.approx(b.tolist()) for a, b in zip(streams[r.user_id], kernels.voice_streams(np.array(r.samples))))


def combs_one_by_one(magnitude, harmonics=6):
    width, limit, total, found = 16000 / (2 * (len(magnitude) - 1)), 3.0 * np.median(magnitude), (magnitude**2).sum() + 1e-10, []
    for f0 in np.arange(80.0, 400.0, 5.0):
        centre = np.rint(f0 * np.arange(1, harmonics + 1) / width).astype(int)
        peaks = np.array([magnitude[max(0, c - 2) : c + 3].max() for c in centre if c < len(magnitude)])
        strong = peaks[peaks > limit]
        if (strong**2).sum() / total >= 0.08 and len(strong) >= 4:
            found.append((float(f0), float((strong**2).sum() / total), len(strong)))
    kept = []
    for c in sorted(found, key=lambda c: (-c[1], c[0])):
        if all(abs(c[0] - k[0]) >= 15.0 for k in kept):
            kept.append(c)
    return kept


@pytest.mark.parametrize("bins", [257, 33, 9])
def test_combs_of_many_spectra_at_once(bins):
    """As one by one, at both ends of the spectrum and where harmonics lie beyond it; a frame takes far less than the 5 ms that a loop over candidates does."""
    rng, t = np.random.default_rng(bins), np.arange(2 * (bins - 1)) / 16000
    x = rng.normal(0, 0.02, (300, len(t)))
    for row in x:
        for f0 in rng.uniform(80, 390, rng.integers(0, 4)):
            row += sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 7)) * rng.uniform(0.05, 0.3)
    spectra = np.vstack([kernels.magnitudes(x), np.zeros((1, bins)), np.eye(1, bins)])
    got = kernels.comb_rows(spectra)
    for m, row in zip(spectra, got):
        want = combs_one_by_one(m)
        assert [(a, c) for a, _, c in row] == [(a, c) for a, _, c in want] and [b for _, b, _ in row] == pytest.approx([b for _, b, _ in want])
        assert kernels.combs(m) == row
    assert bins < 257 or sum(len(row) > 1 for row in got) > 10
