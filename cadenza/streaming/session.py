"""Sessions as a stream: keyed state for voice activity, evidence, speakers and events with cooldown.

A row is one chunk: session_id, chunk_idx (from 0), speech_prob, and of these what there is: samples,
embedding, lip_active, enrolled, control (``reset`` before the chunk; ``summary`` after it).

Chunks are taken in order of chunk_idx across micro-batches: one that comes too early waits in the state
until the gap is filled, or PATIENCE chunks have come after it; one that comes later than that, or a second
time, is left out. Without times nothing tells a lost chunk from one that is still to come: where chunks have
times use timed.py, which waits for no missing chunk and ends silent sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.rules import COOLDOWN_CYCLES
from cadenza.operators.tables import parts
from cadenza.sources.wav import FRAME, RATE, clip_bytes

#: Under the first a voice is another one, from the second on it is the enrolled one; under the third there is no score yet.
UNCERTAIN, MATCH, AVAILABLE = 0.40, 0.72, 0.05
#: Voiced samples from which a voice is embedded; samples of evidence that are kept.
VOICED, EVIDENCE = 2 * RATE, 30 * RATE
PATIENCE = 64
EVENTS = (
    "session_id string, chunk_idx long, event_type string, confidence double, verify_score double, n_speakers int, lip_active boolean, audio_proof binary, "
    "total_chunks_processed long, total_speech_s double, verify_score_mean double, verify_score_min double, enrolled boolean"
)
NAMES = [c.split()[0] for c in EVENTS.split(", ")]
CHUNK = "chunk_idx long, speech_prob double, samples array<double>, embedding array<double>, lip_active boolean, enrolled array<double>, control string"
CHUNK_NAMES = [c.split()[0] for c in CHUNK.split(", ")]
STATE = (
    "chunk long, cycle long, active boolean, run_on long, run_off long, lips boolean, speech long, score double, scores long, score_sum double, score_min double, "
    f"voiced binary, voiced_n long, evidence binary, enrolled array<double>, centres array<array<double>>, counts array<long>, fired map<string, long>, waiting array<struct<{CHUNK.replace(' ', ': ').replace(',: ', ', ')}>>"
)


def decide(active: bool, lips: bool, score: float, speakers: int) -> tuple[str, float] | None:
    """(type, confidence) of one cycle; the same chain as rules.fusion_decision and rules.event_confidence."""
    scored = score >= AVAILABLE
    strange = (UNCERTAIN - score) / UNCERTAIN
    if active and not lips and scored and score < UNCERTAIN:
        return "IMPERSONATION", min(1.0, strange + 0.3)
    if active and not lips and scored and score >= MATCH:
        return "GHOST_VOICE", min(1.0, score)
    if active and speakers >= 2:
        return "EXTRA_SPEAKER", min(1.0, 0.5 + 0.2 * (speakers - 1))
    if active and scored and score < UNCERTAIN:
        return "VOICE_MISMATCH", min(1.0, strange)
    return None


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-8)


def _floats(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32)


class Session:
    """The state of one session and a step for each chunk."""

    def __init__(self, state: tuple | None = None, threshold: float = 0.45, onset: int = 3, offset: int = 10, merge: float = 0.75, embed: Callable[[np.ndarray], np.ndarray | None] | None = None):
        self.threshold, self.onset, self.offset, self.merge, self.embed = threshold, onset, offset, merge, embed
        self.enrolled: np.ndarray | None = None
        self.chunk, self.waiting = 0, []
        self.reset()
        if state is not None:
            self.chunk, self.cycle, self.active, self.run_on, self.run_off, self.lips, self.speech, self.score, self.scores, self.score_sum, self.score_min, voiced, self.voiced_n, evidence, enrolled, centres, counts, fired, waiting = state
            self.voiced, self.evidence = [_floats(voiced)], [_floats(evidence)]
            self.enrolled = None if enrolled is None else np.array(enrolled, float)
            self.centres, self.counts, self.fired = [np.array(c, float) for c in centres], list(counts), dict(fired)
            self.waiting = [tuple(w) for w in waiting]

    def reset(self) -> None:
        """Clears everything but the enrolled voice and the place in the stream."""
        self.cycle, self.active, self.run_on, self.run_off, self.lips, self.speech = 0, False, 0, 0, False, 0
        self.score, self.scores, self.score_sum, self.score_min = 0.0, 0, 0.0, 0.0
        self.voiced, self.voiced_n, self.evidence, self.centres, self.counts, self.fired = [], 0, [], [], [], {}

    def state(self) -> tuple:
        joined = lambda parts: np.concatenate(parts).astype(np.float32).tobytes() if parts else b""
        return (
            self.chunk, self.cycle, self.active, self.run_on, self.run_off, self.lips, self.speech, self.score, self.scores, self.score_sum, self.score_min,
            joined(self.voiced), self.voiced_n, joined(self.evidence), None if self.enrolled is None else self.enrolled.tolist(), [c.tolist() for c in self.centres], self.counts, self.fired, self.waiting,
        )

    def _heard(self, samples: np.ndarray | None) -> None:
        """Keeps the chunk as evidence: whole chunks go while what is left would still be enough."""
        if samples is None:
            return
        self.evidence.append(np.asarray(samples, np.float32))
        while sum(map(len, self.evidence)) - len(self.evidence[0]) >= EVIDENCE:
            self.evidence.pop(0)

    def _track(self, vector: np.ndarray) -> None:
        v = _unit(vector)
        similar = [float(c @ v) for c in self.centres]
        best = int(np.argmax(similar)) if similar else -1
        if best >= 0 and similar[best] >= self.merge:
            self.centres[best], self.counts[best] = _unit((self.centres[best] * self.counts[best] + v) / (self.counts[best] + 1)), self.counts[best] + 1
        else:
            self.centres.append(v)
            self.counts.append(1)
        self.score = float(self.centres[int(np.argmax(self.counts))] @ _unit(self.enrolled))
        self.score_min = min(self.score_min, self.score) if self.scores else self.score
        self.scores, self.score_sum = self.scores + 1, self.score_sum + self.score

    def push(self, probability: float, embedding: np.ndarray | None = None, lips: bool | None = None, enrolled: np.ndarray | None = None, samples: np.ndarray | None = None) -> tuple[str, float] | None:
        """(type, confidence) of the event that this chunk raises, if it does.

        lips: None leaves the last value. An embedding that comes with a chunk is used as it is; without
        one, samples of active chunks are gathered until there are VOICED of them and then embedded.
        """
        self._heard(samples)
        if enrolled is not None:
            self.enrolled = enrolled
        loud = probability >= self.threshold
        self.run_on, self.run_off = (self.run_on + 1, 0) if loud else (0, self.run_off + 1)
        self.active = self.run_on >= self.onset or self.active and self.run_off < self.offset
        if self.active:
            self.speech += 1
            if samples is not None and self.embed is not None:
                self.voiced.append(np.asarray(samples, np.float32))
                self.voiced_n += len(samples)
        if self.enrolled is not None:
            if self.voiced_n >= VOICED:
                made = self.embed(np.concatenate(self.voiced))
                self.voiced, self.voiced_n = [], 0
                embedding = made if embedding is None else embedding
            if embedding is not None:
                self._track(embedding)
        if lips is not None:
            self.lips = lips
        self.cycle += 1
        if self.enrolled is None:
            return None
        found = decide(self.active, self.lips, self.score, len(self.centres))
        if found is None or self.cycle - self.fired.get(found[0], -(10**9)) < COOLDOWN_CYCLES[found[0]]:
            return None
        self.fired[found[0]] = self.cycle
        return found

    def proof(self) -> bytes | None:
        """The last seconds as a WAV file."""
        return clip_bytes(np.concatenate(self.evidence)[-EVIDENCE:]) if self.evidence else None

    def summary(self) -> tuple[int, float, float, float, bool]:
        """Chunks, seconds of speech, mean and least score (0 without one), whether a voice is enrolled."""
        return self.cycle, round(self.speech * FRAME / RATE, 2), round(self.score_sum / self.scores, 4) if self.scores else 0.0, round(self.score_min, 4) if self.scores else 0.0, self.enrolled is not None


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    """(chunk_idx, speech_prob, samples, embedding, lip_active, enrolled, control) of each row, None for what there isn't."""
    vector = lambda v: None if v is None or np.ndim(v) == 0 else [float(x) for x in v]
    columns = [pdf[c] if c in pdf else [None] * len(pdf) for c in CHUNK_NAMES]
    for at, probability, samples, embedding, lips, enrolled, control in zip(*columns):
        none = lambda x: x is None or (np.ndim(x) == 0 and pd.isna(x))
        yield int(at), 0.0 if none(probability) else float(probability), vector(samples), vector(embedding), None if none(lips) else bool(lips), vector(enrolled), None if none(control) else str(control)


def _step(session: Session, key: str, row: tuple) -> Iterator[tuple]:
    at, probability, samples, embedding, lips, enrolled, control = row
    as_array = lambda v: None if v is None else np.array(v, float)
    if control == "reset":
        session.reset()
    event = session.push(probability, as_array(embedding), lips, as_array(enrolled), as_array(samples))
    session.chunk = at + 1
    if event:
        yield key, at, event[0], round(event[1], 3), round(session.score, 4), len(session.centres), session.lips, session.proof(), *[None] * 5
    if control == "summary":
        yield key, at, "SUMMARY", None, round(session.score, 4), len(session.centres), session.lips, None, *session.summary()


def run_chunks(session: Session, key: str, rows: pd.DataFrame, patience: int | None = None) -> Iterator[tuple]:
    """Events of rows in order of chunk_idx. patience: early chunks wait for those before them; None: a gap is a gap."""
    ready = sorted([*session.waiting, *_rows(rows)], key=lambda r: r[0])
    session.waiting = []
    for n, row in enumerate(ready):
        if row[0] < session.chunk:
            continue  # too late, or a second copy
        if patience is not None and row[0] > session.chunk and ready[-1][0] - row[0] < patience:
            session.waiting = ready[n:]
            return
        yield from _step(session, key, row)


def _frame(events: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(events, columns=NAMES)
    return out.astype({"n_speakers": "Int32", "total_chunks_processed": "Int64", "confidence": float, "total_speech_s": float, "verify_score_mean": float, "verify_score_min": float})


class SessionProcessor(StatefulProcessor):
    """One value of state for each session: bounded by its evidence, its speakers and PATIENCE chunks."""

    def __init__(self, embed: Callable[[np.ndarray], np.ndarray | None] | None = None):
        self.embed = embed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = Session(self.held.get() if self.held.exists() else None, embed=self.embed)
        events = [e for pdf in rows for e in run_chunks(session, key[0], pdf, PATIENCE)]
        self.held.update(session.state())
        yield _frame(events)

    def close(self) -> None:
        pass


def session_events(chunks: DataFrame, embed: Callable[[np.ndarray], np.ndarray | None] | None = None) -> DataFrame:
    """EVENTS of a stream of chunks. embed: a voice's vector from its samples. Needs the RocksDB state store."""
    return chunks.groupBy("session_id").transformWithStateInPandas(SessionProcessor(embed), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def session_events_batch(chunks: DataFrame, embed: Callable[[np.ndarray], np.ndarray | None] | None = None, summaries: bool = False) -> DataFrame:
    """The same events of a table: each session is streamed in order of chunk_idx. summaries: one SUMMARY row for each session too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session = None, None

        def ended() -> list[tuple]:
            return [(key, session.chunk - 1, "SUMMARY", None, round(session.score, 4), len(session.centres), session.lips, None, *session.summary())] if summaries and session is not None else []

        for batch in batches:
            events = []
            for own, rows in batch.groupby("session_id", sort=False):
                if own != key:
                    events += ended()
                    key, session = own, Session(embed=embed)
                events += run_chunks(session, own, rows)
            yield _frame(events)
        yield _frame(ended())

    return chunks.repartition(parts(chunks), "session_id").sortWithinPartitions("session_id", "chunk_idx").mapInPandas(run, EVENTS)
