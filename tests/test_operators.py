"""Kernels, sources, folds and streams against independent small versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.operators import folds, islands, vectors
from cadenza.sources import wav


def test_hysteresis_against_a_state_machine(spark):
    rng, rows, want = random.Random(5), [], {}
    for key in range(30):
        on, run, previous = False, 0, None
        for i in range(rng.randint(20, 80)):
            flag = rng.random() < 0.6 if previous is None or rng.random() < 0.3 else previous
            run = run + 1 if flag == previous else 1
            on = True if flag and run >= 3 else False if not flag and run >= 5 else on
            rows.append((key, i, flag))
            want[key, i] = on
            previous = flag
    got = islands.hysteresis(spark.createDataFrame(rows, "k int, i int, f boolean"), ["k"], ["i"], F.col("f"), 3, 5).collect()
    assert {(r.k, r.i): r.active for r in got} == want


def test_greedy_keeps_what_a_plain_anti_join_drops(spark):
    df = spark.createDataFrame([(1, 100, 3.0), (1, 110, 2.0), (1, 120, 1.0)], "k int, p int, s double")
    assert {r.p for r in folds.greedy_apart(df, ["k"], "p", "s", 15).collect()} == {100, 120}


def test_agglomerative_is_not_connected_components(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "r int, node int")
    pairs = spark.createDataFrame([(1, 0, 1, 0.99, 0.92), (1, 0, 2, 0.90, 0.92), (1, 1, 2, 0.85, 0.81)], "r int, a int, b int, similarity double, threshold double")
    assert {r.node: r.cluster for r in vectors.agglomerate(pairs, nodes, "r").collect()} == {0: 0, 1: 0, 2: 1}


def test_kernels_on_tones():
    t = np.arange(512) / 16000
    tone = sum(np.sin(2 * np.pi * 200 * k * t) / k for k in range(1, 6)) * 0.2
    noise = np.random.default_rng(1).normal(0, 0.1, 512)
    f = kernels.frame_features(np.stack([tone, noise, np.zeros(512)]))
    assert f.f0_hz[0] == pytest.approx(200, rel=0.02) and f.f0_hz[2] == 0 and f.rms[2] == 0
    assert f.flatness[1] > f.flatness[0] and f.hnr_db[0] > f.hnr_db[1]
    two = tone + sum(np.sin(2 * np.pi * 120 * k * t) / k for k in range(1, 6)) * 0.2
    spectrum = np.abs(np.fft.rfft(two * np.hanning(512)))
    found = kernels.combs(spectrum)
    assert found and all(abs(a[0] - b[0]) >= 15 for i, a in enumerate(found) for b in found[:i])


def test_wav_round_trip_scan_and_frames(spark, tmp_path):
    x = (np.sin(np.arange(1300) / 10) * 0.5).astype(np.float32)
    (tmp_path / "b.WAV").write_bytes(wav.encode_wav(x))
    (tmp_path / "a.wav").write_bytes(wav.encode_wav(x[:300]))
    (tmp_path / "c.txt").write_text("no")
    recordings = wav.read_recordings(spark, str(tmp_path))
    assert {r.recording_id: len(r.samples) for r in recordings.collect()} == {"a": 300, "b": 1300}
    frames = wav.frames_of(recordings)
    assert sorted((r.recording_id, r.frame_idx) for r in frames.collect()) == [("b", 0), ("b", 1)]
    features = kernels.with_features(frames, ["recording_id", "frame_idx"]).collect()
    assert len(features) == 2 and features[0].rms == pytest.approx(0.35, abs=0.02)
    assert [r.recording_id for r in wav.read_recordings(spark, str(tmp_path), without="b.WAV").collect()] == ["a"]
    assert np.abs(wav.decode_wav(wav.encode_wav(x)) - x).max() < 1e-4
