"""Live sessions in event time: chunks from one stream, lip movement from another.

A chunk is taken up when the watermark has passed its time, so by then every row of either stream up to
that time is there, in whatever order rows arrived. The lips at a chunk are those of the latest lip row at
or before it, unless the chunk has a value of its own; lip rows are no cycles. A lost chunk is just not
there. Rows that come after the watermark has passed them are dropped by Spark; those that it lets through
are counted as late. A chunk_idx that is there already is a repeat, and dropped.

State of a session, by what happens to it: the decision's scalars (one value); chunks and lip rows that wait
(maps, bounded by the watermark's delay); evidence (a map by number, of which single chunks are added and
removed). A timer releases what waits when no other row of the session comes; another one ends a session
that has been silent for ``idle``: it gets its SUMMARY, and all of its state goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.sources.wav import clip_bytes
from cadenza.streaming.session import CHUNK, CHUNK_NAMES, EVENTS, EVIDENCE, NAMES, STATE, Session, _floats, _rows, _step

TIMED_EVENTS = f"{EVENTS}, late_rows long"
CLOCK = "first long, next long, samples long, until long, seen long, late long, release long, end long"
INPUT = ["session_id", "ts", "is_lip", *CHUNK_NAMES]


class TimedSession(Session):
    """A session whose evidence is elsewhere."""

    def __init__(self, state: tuple | None, heard: Callable[[np.ndarray], None], kept: Callable[[], np.ndarray | None], embed: Callable | None):
        super().__init__(state, embed=embed)
        self.evidence, self.heard, self.kept = [], heard, kept

    def _heard(self, samples: np.ndarray | None) -> None:
        if samples is not None:
            self.heard(np.asarray(samples, np.float32))

    def proof(self) -> bytes | None:
        samples = self.kept()
        return None if samples is None else clip_bytes(samples[-EVIDENCE:])


def both(chunks: DataFrame, lips: DataFrame | None, delay: str | None) -> DataFrame:
    """One tagged table of both: chunks (session_id, ts and what session.CHUNK names, as far as it is there) and lips (session_id, ts, lip_active)."""
    kinds = dict(c.split(" ", 1) for c in CHUNK.split(", "))
    watermarked = lambda df: df.withWatermark("ts", delay) if delay else df
    column = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c)
    found = watermarked(chunks).select("session_id", "ts", F.lit(False).alias("is_lip"), *[column(chunks, c) for c in CHUNK_NAMES])
    if lips is None:
        return found
    only = lips.select("session_id", "ts", "lip_active")
    return found.union(watermarked(only).select("session_id", "ts", F.lit(True).alias("is_lip"), *[column(only, c) for c in CHUNK_NAMES]))


def _times(pdf: pd.DataFrame) -> list[int]:
    return (pdf["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[np.datetime_data(pdf["ts"].dtype)[0]]).tolist()


def _frame(events: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(events, columns=[*NAMES, "late_rows"])
    return out.astype({"n_speakers": "Int32", "total_chunks_processed": "Int64", "late_rows": "Int64", "confidence": float, "total_speech_s": float, "verify_score_mean": float, "verify_score_min": float})


class TimedProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int, embed: Callable[[np.ndarray], np.ndarray | None] | None = None):
        self.idle_ms, self.embed = idle_ms, embed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", STATE)
        self.clock = handle.getValueState("clock", CLOCK)
        self.waiting = handle.getMapState("waiting", "chunk_idx long", f"at long, {CHUNK}")
        self.lips = handle.getMapState("lips", "at long", "lip_active boolean")
        self.evidence = handle.getMapState("evidence", "n long", "samples binary")

    def _load(self) -> None:
        self.first, self.next, self.samples, self.until, self.seen, self.late, self.release, self.end = self.clock.get() if self.clock.exists() else (0, 0, 0, -1, 0, 0, -1, -1)
        self.session = TimedSession(self.held.get() if self.held.exists() else None, self._hear, self._kept, self.embed)

    def _hear(self, samples: np.ndarray) -> None:
        self.evidence.updateValue((self.next,), (samples.tobytes(),))
        self.next, self.samples = self.next + 1, self.samples + len(samples)
        while self.first < self.next - 1 and self.samples - (n := len(_floats(self.evidence.getValue((self.first,))[0]))) >= EVIDENCE:
            self.evidence.removeKey((self.first,))
            self.first, self.samples = self.first + 1, self.samples - n

    def _kept(self) -> np.ndarray | None:
        parts = [_floats(self.evidence.getValue((n,))[0]) for n in range(self.first, self.next)]
        return np.concatenate(parts) if parts else None

    def _ready(self, key: str, watermark: int) -> Iterator[tuple]:
        """Events of all chunks up to the watermark, in order of time; lip rows go where they belong between them."""
        pending = [(value[0], index[0], tuple(value)) for index, value in self.waiting.iterator()]
        moves = sorted((at[0], value[0]) for at, value in self.lips.iterator())
        ready, at_lip = sorted((p for p in pending if p[0] <= watermark), key=lambda p: p[:2]), 0
        for at, index, value in ready:
            while at_lip < len(moves) and moves[at_lip][0] <= at:
                self.session.lips = moves[at_lip][1]
                at_lip += 1
            lips = self.session.lips
            if value[CHUNK_NAMES.index("control") + 1] == "reset":
                self.session.reset()
                self.session.lips = lips
                self._forget()
                value = (*value[:-1], None)
            yield from _step(self.session, key, value[1:])
            self.waiting.removeKey((index,))
        while at_lip < len(moves) and moves[at_lip][0] <= watermark:
            self.session.lips = moves[at_lip][1]
            at_lip += 1
        for at, _ in moves[:at_lip]:
            self.lips.removeKey((at,))
        self.until = max(self.until, watermark)
        left = [p[0] for p in pending if p[0] > watermark] + [at for at, _ in moves[at_lip:]]
        self._timer("release", min(left) if left else -1)

    def _timer(self, name: str, at: int) -> None:
        """Sets one of the two timers, -1 for none; timers are known by their times alone, and may have the same one."""
        old, other = (self.release, self.end) if name == "release" else (self.end, self.release)
        if old != at:
            if old >= 0 and old != other:
                self.handle.deleteTimer(old)
            if at >= 0 and at != other:
                self.handle.registerTimer(at)
            setattr(self, name, at)

    def _forget(self) -> None:
        for n in range(self.first, self.next):
            self.evidence.removeKey((n,))
        self.first, self.samples = self.next, 0

    def _store(self) -> None:
        self.held.update(self.session.state())
        self.clock.update((self.first, self.next, self.samples, self.until, self.seen, self.late, self.release, self.end))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for pdf in rows:
            chunk = list(_rows(pdf.assign(chunk_idx=pdf["chunk_idx"].fillna(-1))))
            for at, is_lip, row in zip(_times(pdf), pdf["is_lip"], chunk):
                self.seen = max(self.seen, at)
                if at <= self.until:
                    self.late += 1
                elif is_lip:
                    if row[4] is not None:  # of two at one time, one that moves
                        self.lips.updateValue((at,), (row[4] or self.lips.containsKey((at,)) and self.lips.getValue((at,))[0],))
                elif not self.waiting.containsKey((row[0],)) and row[0] >= self.session.chunk:
                    self.waiting.updateValue((row[0],), (at, *row))
        events = [(*e, self.late) for e in self._ready(key[0], timerValues.getCurrentWatermarkInMs())]
        self._timer("end", self.seen + self.idle_ms)
        self._store()
        yield _frame(events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return  # the session has ended by another timer
        self._load()
        watermark, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        self.release, self.end = (-1 if self.release == fired else self.release), (-1 if self.end == fired else self.end)
        events = [(*e, self.late) for e in self._ready(key[0], watermark)]
        if self.seen + self.idle_ms <= watermark:
            s = self.session
            events.append((key[0], s.chunk - 1, "SUMMARY", None, round(s.score, 4), len(s.centres), s.lips, None, *s.summary(), self.late))
            self._timer("release", -1)
            self._timer("end", -1)
            for state in (self.held, self.clock, self.waiting, self.lips, self.evidence):
                state.clear()
        else:
            if self.end < 0:
                self._timer("end", self.seen + self.idle_ms)
            self._store()
        yield _frame(events)

    def close(self) -> None:
        pass


def timed_session_events(chunks: DataFrame, lips: DataFrame | None = None, delay: str = "10 seconds", idle_ms: int = 600_000, embed: Callable[[np.ndarray], np.ndarray | None] | None = None) -> DataFrame:
    """TIMED_EVENTS of streams of chunks and of lip rows. delay: how much later than others a row may come. Needs the RocksDB state store."""
    return both(chunks, lips, delay).groupBy("session_id").transformWithStateInPandas(TimedProcessor(idle_ms, embed), outputStructType=TIMED_EVENTS, outputMode="Append", timeMode="EventTime")


def timed_session_events_batch(chunks: DataFrame, lips: DataFrame | None = None, embed: Callable[[np.ndarray], np.ndarray | None] | None = None) -> DataFrame:
    """The same events of tables, and each session's SUMMARY at its end: rows of a session are streamed in order of time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session, seen, moves = None, None, set(), False

        def ended() -> list[tuple]:
            return [(key, session.chunk - 1, "SUMMARY", None, round(session.score, 4), len(session.centres), session.lips, None, *session.summary(), 0)] if session is not None else []

        for batch in batches:
            events = []
            for own, is_lip, row in zip(batch["session_id"], batch["is_lip"], _rows(batch.assign(chunk_idx=batch["chunk_idx"].fillna(-1)))):
                if own != key or session is None:
                    events += ended()
                    key, session, moves = own, Session(embed=embed), False
                if is_lip:
                    session.lips = session.lips if row[4] is None else row[4]
                elif row[0] >= session.chunk:
                    if row[6] == "reset":
                        moves = session.lips
                        session.reset()
                        session.lips, row = moves, (*row[:6], None)
                    events += [(*e, 0) for e in _step(session, own, row)]
            yield _frame(events)
        yield _frame(ended())

    ordered = both(chunks, lips, None).repartition("session_id").sortWithinPartitions("session_id", "ts", F.col("is_lip").desc(), F.col("lip_active"), "chunk_idx")
    return ordered.mapInPandas(run, TIMED_EVENTS)
