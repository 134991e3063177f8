"""Enrolment with a stub model; components and agglomeration against naive versions; combs as columns against the kernel."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import combs, enrolment, kernels
from cadenza.operators import components, vectors


@pytest.fixture
def stub():
    """Makes a model whose vector is (mean, deviation); it finds no voice in silence and fails where a sample is over 1."""

    def load():
        def model(x):
            if x.max() > 1:
                raise RuntimeError("too loud")
            return None if not x.any() else np.array([x.mean(), x.std()]) * 5

        return model

    return load


def test_enrolment_by_chunks_and_its_exceptions(spark, stub):
    rng = np.random.default_rng(1)
    voice = lambda seconds, mean: rng.normal(mean, 0.1, int(seconds * 16000)).clip(-1, 1).astype(np.float32)
    audio = {"long": voice(9.9, 0.2), "short": voice(1.0, 0.3), "bad": voice(6.5, 0.1)}
    audio["bad"][:48000] = 0
    audio["silent then fails"] = np.concatenate([np.zeros(48000, np.float32), np.full(48000, 2.0, np.float32), voice(3, 0.4)])
    rows = [(k, k[:4], x.tolist()) for k, x in audio.items()]
    recordings = spark.createDataFrame(rows, "recording_id string, person string, samples array<float>").repartition(3)
    unit = lambda v: v / np.linalg.norm(v)
    vector = lambda x: unit(np.array([x.mean(), x.std()], float))
    want = {"long": [vector(audio["long"][i : i + 48000]) for i in (0, 48000, 96000)], "short": [vector(audio["short"])], "bad": [vector(audio["bad"][48000:96000])], "silent then fails": [vector(audio["silent then fails"][96000:])]}
    got = {r.recording_id: (r.n, r.centroid) for r in enrolment.enrolled(recordings, stub).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(unit(np.mean(v, 0)).tolist(), abs=1e-5) for k, v in want.items())
    people = {r.person: r.n for r in enrolment.enrolled(recordings, stub, key="person").collect()}
    assert people == {"long": 3, "shor": 1, "bad": 1, "sile": 1}
    brief = spark.createDataFrame([("x", [0.1] * 7000)], "recording_id string, samples array<float>")
    for few in (brief, spark.createDataFrame([("x", [0.0] * 16000), ("y", None)], "recording_id string, samples array<float>")):
        with pytest.raises(Exception, match="no voice in the audio"):
            enrolment.enrolled(few, stub).collect()
    trimmed = recordings.withColumn("v", enrolment.embedding(F.col("samples"), stub, prepare=lambda x: x[: int(0.4 * 16000)]))
    assert trimmed.where("v is not null").count() == 0


def test_a_model_is_loaded_once_a_task(spark, stub):
    calls = spark.sparkContext.accumulator(0)

    def load():
        calls.add(1)
        return stub()

    many = spark.range(0, 3000, 1, 1).select(F.col("id"), F.array_repeat(F.lit(0.1), 8000).alias("samples"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    found = many.select(enrolment.embedding(F.col("samples"), load).alias("v")).collect()
    assert sum(r.v is not None for r in found) == 3000
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert calls.value == 1


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_components_against_union_find(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    rng = random.Random(held)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive(nodes, pairs):
    """Merges the two clusters with the largest excess, by looking at all of them each time."""
    clusters = [[n] for n in sorted(nodes)]
    best = {}
    for a, b, s, t in pairs:
        if (a, b) not in best or s > best[a, b][0]:
            best[a, b] = (s, t)
    while True:
        options = []
        for i, one in enumerate(clusters):
            for j in range(i + 1, len(clusters)):
                found = [best[min(a, b), max(a, b)] for a in one for b in clusters[j] if (min(a, b), max(a, b)) in best]
                if found:
                    s, t = max(found, key=lambda x: x[0])
                    if s >= t:
                        options.append((t - s, one[0], clusters[j][0], i, j))
        if not options:
            return {n: k for k, c in enumerate(sorted(clusters, key=min)) for n in c}
        _, _, _, i, j = min(options)
        clusters[i] = sorted(clusters[i] + clusters.pop(j))


def test_agglomerate_by_components_against_all_pairs(spark):
    rng, nodes, pairs, want = random.Random(9), [], [], {}
    for key in ("a", "b", None):
        own = list(range(100, 128))
        mine = [(a, b, round(rng.random(), 6), rng.choice([0.8, 0.92, 0.97])) for a in own for b in own if a < b and rng.random() < 0.3]
        nodes += [(key, n) for n in own]
        pairs += [(key, *p) for p in mine]
        want |= {(key, n): c for n, c in naive(own, mine).items()}
    pairs.append(("a", 100, 101, None, 0.5))
    got = {(r.k, r.node): r.cluster for r in vectors.agglomerate(spark.createDataFrame(pairs, "k string, a long, b long, similarity double, threshold double").repartition(4), spark.createDataFrame(nodes, "k string, node long"), "k").collect()}
    assert got == want and len(set(want.values())) < 28
    empty = spark.createDataFrame([], "k string, a long, b long, similarity double, threshold double")
    assert [r.cluster for r in vectors.agglomerate(empty, spark.createDataFrame([("x", 1), ("x", 2)], "k string, node long"), "k").orderBy("node").collect()] == [0, 1]


@pytest.mark.parametrize("ties", [False, True])
def test_agglomerate_of_large_components_in_rounds(spark, monkeypatch, ties):
    """No task holds more than HEAP pairs of clusters, and what is merged is the same, equal excesses too."""
    monkeypatch.setattr(vectors, "HEAP", 40)
    sizes = spark.sparkContext.accumulator(0)
    heap = vectors._heap

    def counted(pairs):
        sizes.add(len(pairs) > 40)
        return heap(pairs)

    monkeypatch.setattr(vectors, "_heap", counted)
    rng, own = random.Random(5), list(range(30))
    mine = [(a, b, round(rng.random(), 1 if ties else 6), 0.8 if ties else rng.choice([0.7, 0.8, 0.9])) for a in own for b in own if a < b and rng.random() < 0.5]
    mine = [(a, b, s, t) if not ties or s >= t or rng.random() < 0.8 else (a, b, 0.95, 0.97) for a, b, s, t in mine]
    pairs = spark.createDataFrame([("x", *p) for p in mine], "k string, a long, b long, similarity double, threshold double").repartition(3)
    got = {r.node: r.cluster for r in vectors.agglomerate(pairs, spark.createDataFrame([("x", n) for n in own], "k string, node long"), "k").collect()}
    assert got == naive(own, mine) and 1 < len(set(got.values())) < 30
    assert sizes.value == 0


def test_agglomerate_with_one_threshold_holds_no_component(spark, monkeypatch):
    """Where no pair hides another one, a task passes on one edge for each node: no group of all pairs is made."""

    def grouped(numbered):
        raise AssertionError("pairs were grouped")

    monkeypatch.setattr(vectors, "_merges", grouped, raising=False)
    rng, own = random.Random(2), list(range(60))
    mine = [(a, b, round(rng.random(), 6), 0.96) for a in own for b in own if a < b]
    pairs = spark.createDataFrame([(None, *p) for p in mine], "k string, a long, b long, similarity double, threshold double").repartition(3)
    got = {r.node: r.cluster for r in vectors.agglomerate(pairs, spark.createDataFrame([(None, n) for n in own], "k string, node long"), "k").collect()}
    assert got == naive(own, mine) and 1 < len(set(got.values())) < 60


@pytest.mark.parametrize("kind", ["float", "double"])
def test_similar_pairs_of_copies_in_pieces(spark, monkeypatch, kind):
    """All pairs are similar: a block's pairs leave a task in pieces of at most PRODUCTS."""
    monkeypatch.setattr(vectors, "PRODUCTS", 100)
    df = spark.createDataFrame([("x", i, [1.0, 2.0]) for i in range(40)] + [("y", 1, [0.0, 0.0])], f"k string, i long, v array<{kind}>")
    got = sorted((r.k, r.a, r.b) for r in vectors.similar_pairs(df, "k", "i", "v", 0.9).collect())
    assert got == [("x", a, b) for a in range(40) for b in range(a + 1, 40)]


def test_combs_as_columns_against_the_kernel(spark):
    rng, t, rows = np.random.default_rng(3), np.arange(512) / 16000, []
    for i in range(40):
        x = rng.normal(0, 0.02, 512)
        for f0 in rng.uniform(80, 390, rng.integers(0, 4)):
            x = x + sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 7)) * rng.uniform(0.05, 0.3)
        rows.append((i, x.tolist()))
    rows += [(100, [0.0] * 512), (101, [1.0] + [0.0] * 511)]
    frames = spark.createDataFrame(rows, "i int, samples array<double>")
    got = {r.i: [(c.f0_hz, c.score, c.n_harmonics) for c in r.combs] for r in kernels.with_spectra(frames, ["i"]).select("i", combs.combs(F.col("magnitude")).alias("combs")).collect()}
    for i, x in rows:
        want = kernels.combs(kernels.magnitudes(np.array([x]))[0])
        assert [(a, c) for a, _, c in got[i]] == [(a, c) for a, _, c in want]
        assert [b for _, b, _ in got[i]] == pytest.approx([b for _, b, _ in want])
    assert any(len(v) >= 2 for v in got.values())
