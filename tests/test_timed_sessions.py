"""Two streams in event time against an independent loop: lips early, late and between chunks; lost, repeated and late chunks; silent sessions."""

import datetime as dt
import random

import numpy as np
import pytest

from cadenza.streaming import session, timed
from test_signals import independent

CHUNK = "session_id string, ts timestamp, chunk_idx long, speech_prob double, samples array<double>, embedding array<double>, lip_active boolean, enrolled array<double>, control string"
LIP = "session_id string, ts timestamp, lip_active boolean"
START = dt.datetime(2024, 5, 1, 12)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def talk(sessions=2, n=260):
    """(chunks, lips): chunks each 32 ms; lip rows at times between them."""
    rng, chunks, lips = np.random.default_rng(4), [], []
    for s in range(sessions):
        enrolled = rng.normal(size=8)
        enrolled /= np.linalg.norm(enrolled)
        for i in range(n):
            v = (enrolled if i % 80 < 40 else rng.normal(size=8)).tolist() if i % 10 == 5 and i > 20 else None
            chunks.append((f"s{s}", at(32 * i), i, float(rng.random() * 0.5 + 0.3), rng.normal(0, 0.1, 16).tolist(), v, None, enrolled.tolist() if i == 3 else None, None))
            if rng.random() < 0.2:
                lips.append((f"s{s}", at(32 * i + int(rng.integers(0, 31))), bool(rng.random() < 0.4)))
    return chunks, lips


def wanted(chunks, lips):
    """The plain loop's events, with the lips that hold at each chunk written to it."""
    rows = []
    for key in sorted({c[0] for c in chunks}):
        seen = set()
        for c in sorted((c for c in chunks if c[0] == key), key=lambda c: c[1]):
            if c[2] in seen:
                continue
            seen.add(c[2])
            before = [lip for k, t, lip in sorted(lips) if k == key and t <= c[1]]
            rows.append((key, c[2], c[3], c[4], c[5], before[-1] if before else None, c[7], c[8]))
    return [w for w in independent(rows) if w[2] != "SUMMARY"]


def plain(r):
    return r.session_id, r.chunk_idx, r.event_type, r.confidence, r.verify_score, r.n_speakers, r.lip_active, (len(r.audio_proof) - 44) // 2


def streamed(spark, tmp_path, batches, name, delay="3 seconds", idle_ms=20_000):
    """batches: (chunks, lips) of each micro-batch."""
    for n, (chunks, lips) in enumerate(batches):
        spark.createDataFrame(chunks, CHUNK).coalesce(1).write.parquet(str(tmp_path / "chunks" / f"p{n:03}"))
        spark.createDataFrame(lips, LIP).coalesce(1).write.parquet(str(tmp_path / "lips" / f"p{n:03}"))
    read = lambda kind, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / kind / "*"))
    out = timed.timed_session_events(read("chunks", CHUNK), read("lips", LIP), delay, idle_ms)
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    query.stop()
    return spark.table(name).collect(), states


def test_batch_against_the_loop(spark):
    chunks, lips = talk()
    lost = [c for c in chunks if c[2] not in (10, 77, 78)]
    for rows in (chunks, lost, lost + lost[40:60]):
        got = timed.timed_session_events_batch(spark.createDataFrame(rows, CHUNK), spark.createDataFrame(lips, LIP)).collect()
        assert sorted(plain(r) for r in got if r.event_type != "SUMMARY") == sorted(wanted(rows, lips))
        assert sorted((r.session_id, r.total_chunks_processed) for r in got if r.event_type == "SUMMARY") == [(k, len({c[2] for c in rows if c[0] == k})) for k in ("s0", "s1")]


@pytest.mark.parametrize("kind", ["lost and repeated", "lips early", "lips late"])
def test_streams_against_the_loop(spark, tmp_path, kind):
    """Rows come in any order within the delay; a last row of another session moves the watermark on, so that all sessions end."""
    chunks, lips = talk()
    chunks = [c for c in chunks if not (c[0] == "s0" and c[2] in (10, 77, 78))]
    rng = random.Random(kind)
    shift = {"lips early": -1500, "lips late": 1500}.get(kind, 0)
    arrival = lambda t, extra: (t - START).total_seconds() * 1000 + rng.uniform(0, 1000) + extra
    chunk_order = sorted(((arrival(c[1], 0), c) for c in chunks), key=lambda x: x[0])
    lip_order = sorted(((arrival(r[1], shift), r) for r in lips), key=lambda x: x[0])
    batches = []
    for lo in range(-2000, 13_000, 1500):
        some = [c for t, c in chunk_order if lo <= t < lo + 1500]
        batches.append((some + (some[:4] if kind == "lost and repeated" else []), [r for t, r in lip_order if lo <= t < lo + 1500]))
    batches.append(([("end", at(60_000), 0, 0.1, [0.0], None, None, None, None)], [("end", at(60_000), False)]))
    batches.append(([("end", at(61_000), 1, 0.1, [0.0], None, None, None, None)], [("end", at(61_000), False)]))
    got, states = streamed(spark, tmp_path, batches, "timed_" + kind.replace(" ", "_"))
    assert sorted(plain(r) for r in got if r.event_type != "SUMMARY") == sorted(wanted(chunks, lips))
    ends = {r.session_id: (r.total_chunks_processed, r.late_rows) for r in got if r.event_type == "SUMMARY"}
    assert ends == {"s0": (257, 0), "s1": (260, 0)}
    assert states[-1] < 20 < max(states)  # what silent sessions held is gone


def test_a_late_row_changes_nothing(spark, tmp_path):
    chunks, lips = talk(1, 200)
    late = chunks[20]
    first = [c for c in chunks if c is not late]
    batches = [(first[:100], lips), (first[100:], []), ([("end", at(20_000), 0, 0.1, None, None, None, None, None)], [("end", at(20_000), False)]), ([late], []), ([("end", at(90_000), 1, 0.1, None, None, None, None, None)], [("end", at(90_000), True)])]
    got, _ = streamed(spark, tmp_path, batches, "timed_late")
    assert sorted(plain(r) for r in got if r.event_type != "SUMMARY") == sorted(wanted(first, lips))


def test_evidence_is_added_to_and_not_rewritten():
    """Only single entries of the map change; the proof is that of the plain session."""

    class Map(dict):
        writes = 0

        def updateValue(self, k, v):
            Map.writes += 1
            self[k] = v

        getValue, removeKey = dict.__getitem__, dict.pop

    p = timed.TimedProcessor(1000)
    p.evidence, p.first, p.next, p.samples = Map(), 0, 0, 0
    live, whole = timed.TimedSession(None, p._hear, p._kept, None), session.Session()
    rng = np.random.default_rng(1)
    for i in range(1100):
        x = rng.normal(0, 0.1, 512 + i % 3)
        live.push(0.1, samples=x)
        whole.push(0.1, samples=x)
    assert live.proof() == whole.proof() and Map.writes == 1100 and p.first > 100 and len(p.evidence) == p.next - p.first


def test_live_sessions_shuffle_no_chunks_by_their_vector(spark):
    """Four of five chunks name no vector: by a shuffle for the join they would be one task's, however large the table."""
    from cadenza.plans import voices

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = voices.live_sessions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "hashpartitioning(_vec" not in plan
