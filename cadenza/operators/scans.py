"""Mergeable scans: folds in order whose long keys are many tasks' work.

Rows go through a range shuffle by keys and order, so a key with many rows is spread over several parts. A
task folds the keys that begin in its part. The first key of a part may have begun before: of its rows the
task makes a summary, what the fold does to any state that it may begin with. Summaries of a key are
composed in order (a few bytes for each part), which gives the state that each part begins with, and
the parts' first keys are then folded in parallel. Other keys are done after one shuffle.

A program says what is folded: ``fresh()`` is a key's first state; ``step(state, *values)`` is (next state,
the row's made values, or None if the row goes); ``summary()`` has ``push(*values)`` and ``packed()``;
``after(packed, state)`` is the state behind a block. States and packed summaries are small and can be pickled.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cadenza.operators.streamed import KINDS, in_order

DONE, TODO, SUMMARY, STATE = 0, 1, 2, 3


def same(a: tuple, b: tuple) -> bool:
    """Whether keys are equal; null and a number that isn't one equal themselves."""
    return a == b or repr(a) == repr(b)


class Hysteresis:
    """On at the onset-th flagged row in a row, off at the offset-th other one. A state is (on, last flag, rows that had it, as far as they count); its summary is the table of all states."""

    def __init__(self, onset: int = 3, offset: int = 10):
        self.onset, self.offset, self.most = onset, offset, max(onset, offset)

    def fresh(self) -> tuple:
        return False, None, 0

    def step(self, state: tuple, flag: bool | None) -> tuple[tuple, tuple]:
        on, last, n = state
        flag = bool(flag)
        n = min(n + 1, self.most) if flag == last else 1
        on = True if flag and n >= self.onset else False if not flag and n >= self.offset else on
        return (on, flag, n), (on,)

    def summary(self) -> Table:
        flags = [(on, flag, n) for on in (False, True) for flag in (False, True) for n in range(1, self.most + 1)]
        return Table(self, [self.fresh(), *flags])

    def after(self, packed: dict, state: tuple) -> tuple:
        return packed[state]


class Table:
    """Where a block leads from each of a program's states; those that have met go on as one."""

    def __init__(self, program: Hysteresis, states: list[tuple]):
        self.program, self.now = program, {s: [s] for s in states}

    def push(self, *values: object) -> None:
        then: dict[tuple, list] = {}
        for state, begun in self.now.items():
            then.setdefault(self.program.step(state, *values)[0], []).extend(begun)
        self.now = then

    def packed(self) -> dict:
        return {s: state for state, begun in self.now.items() for s in begun}


class Cooldown:
    """Rows fire that are at least ``spacing`` after the one that fired before. A state is the index that fired last, or None."""

    def __init__(self, spacing: float):
        self.spacing = spacing

    def fresh(self) -> None:
        return None

    def step(self, fired: float | None, at: float | None) -> tuple:
        if at is None or fired is not None and at - fired < self.spacing:
            return fired, None
        return at, ()

    def summary(self) -> Chains:
        return Chains(self.spacing)

    def after(self, packed: tuple, fired: float | None) -> float | None:
        bounds, ends = packed
        if not bounds:
            return fired
        way = 0 if fired is None else bisect_left(bounds, fired)
        return ends[way] if way < len(ends) else fired


class Chains:
    """Every way to go through a block: by the first row that fires, which is one of those within spacing of the block's first.

    A way is a class of last firings before the block: those up to its bound. Ways that fire at one row go on together.
    """

    def __init__(self, spacing: float):
        self.spacing, self.bounds, self.ways = spacing, [], deque()
        self.first: float | None = None
        self.open = True

    def push(self, at: float | None) -> None:
        if at is None:
            return
        self.first = at if self.first is None else self.first
        merged: list[int] = []
        while self.ways and at - self.ways[0][0] >= self.spacing:
            met = self.ways.popleft()[1]
            merged, met = (merged, met) if len(merged) >= len(met) else (met, merged)
            merged += met
        if self.open and (not self.bounds or at - self.spacing > self.bounds[-1]):
            merged.append(len(self.bounds))
            self.bounds.append(at - self.spacing)
        self.open = at - self.first < self.spacing
        if merged:
            self.ways.append((at, merged))

    def packed(self) -> tuple[list[float], list[float]]:
        ends = [0.0] * len(self.bounds)
        for at, ways in self.ways:
            for w in ways:
                ends[w] = at
        return self.bounds, ends


class Floor:
    """A level that calibrates itself, then follows the rows that aren't speech. A state is (values seen, or None once calibrated; level).

    A block's summary: its first rows as they are, as many as calibrate; of the others max(m, a * level + b),
    which is closed under composition.
    """

    def __init__(self, floor: Callable):
        self.floor = floor

    def fresh(self) -> tuple:
        floor = self.floor()
        return tuple(floor.seen), floor.level

    def step(self, state: tuple, value: float | None, speech: bool | None) -> tuple[tuple, tuple]:
        seen, level = state
        if value is None:
            return state, (level,)
        floor = self.floor()
        floor.seen, floor.level = None if seen is None else list(seen), level
        level = floor.push(value, bool(speech))
        return (None if floor.seen is None else tuple(floor.seen), level), (level,)

    def summary(self) -> Affine:
        return Affine(self.floor())

    def after(self, packed: tuple, state: tuple) -> tuple:
        rows, a, b, m = packed
        for value, speech in rows:
            state = self.step(state, value, speech)[0]
        return (None, max(m, a * state[1] + b)) if state[0] is None else state


class Affine:
    def __init__(self, floor):
        self.floor, self.rows, self.a, self.b, self.m = floor, [], 1.0, 0.0, float("-inf")

    def push(self, value: float | None, speech: bool | None) -> None:
        if value is None:
            return
        if len(self.rows) < self.floor.calibrate:
            self.rows.append((value, bool(speech)))
        elif not speech:
            keep, add = 1 - self.floor.alpha, value * self.floor.alpha
            self.a, self.b, self.m = self.a * keep, self.b * keep + add, max(self.floor.least, self.m * keep + add)

    def packed(self) -> tuple:
        return self.rows, self.a, self.b, self.m


class Groups:
    """Numbers groups of intervals: a new one begins ``gap`` or more after the end of the interval before. A state is (last end, number)."""

    def __init__(self, gap: float):
        self.gap = gap

    def fresh(self) -> tuple:
        return None, -1

    def step(self, state: tuple, start: float | None, end: float | None) -> tuple:
        last, number = state
        if start is None or end is None:
            return state, None
        number += last is None or start - last >= self.gap
        return (end, number), (number,)

    def summary(self) -> Inner:
        return Inner(self)

    def after(self, packed: tuple, state: tuple) -> tuple:
        first, end, inner = packed
        return state if first is None else (end, self.step(state, first, end)[0][1] + inner)


class Inner:
    """First start, last end, and how many groups begin after the first interval."""

    def __init__(self, groups: Groups):
        self.groups, self.first, self.state = groups, None, groups.fresh()

    def push(self, start: float | None, end: float | None) -> None:
        if self.first is None and start is not None and end is not None:
            self.first = start
        self.state = self.groups.step(self.state, start, end)[0]

    def packed(self) -> tuple:
        return self.first, self.state[0], self.state[1]


def scanned(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], made: dict[str, str], program: object, pass_on: tuple[str, ...] = ()) -> DataFrame:
    """keys, order, the columns in pass_on and those in made: as streamed.in_order, by a program whose blocks can be summarised.

    The folded rows are written once in the shared folder (operators never read them back whole for a key).
    """
    from cadenza.operators.tables import written

    rows = df.select(*dict.fromkeys([*keys, *order, *pass_on, *inputs]))
    kept = list(dict.fromkeys([*keys, *order, *pass_on]))
    carried = [c for c in inputs if c not in kept]
    extra = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in made.items())).fields if made else []
    nullable = lambda f: StructField(f.name, f.dataType, True)
    schema = StructType([*[nullable(rows.schema[c]) for c in [*kept, *carried]], *extra, *StructType.fromDDL("_part int, _what int, _blob binary").fields])
    names = [*kept, *carried, *made, "_part", "_what", "_blob"]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, state, block, last = TaskContext.get().partitionId(), None, None, None, None

        def record(what: int, blob: object) -> pa.RecordBatch:
            """The key of the row that was read last, and what follows from its rows."""
            columns = [last.column(c) if c in keys else pa.nulls(1, last.schema.field(c).type) for c in [*kept, *carried]]
            columns += [pa.nulls(1, KINDS[k]) for k in made.values()]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.int32()), pa.array([what], pa.int32()), pa.array([pickle.dumps(blob)], pa.binary())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            whose = list(zip(*(batch.column(c).to_pylist() for c in keys))) if keys else [()] * batch.num_rows
            values = list(zip(*(batch.column(c).to_pylist() for c in inputs)))
            at, what, out, closed = [], [], [], []
            for i, (key, given) in enumerate(zip(whose, values)):
                if now is None:
                    now, block = key, program.summary()
                elif key != now and not same(key, now):
                    if block is not None:
                        before = batch.slice(i - 1, 1) if i else last
                        closed.append((before, block.packed()))
                        block = None
                    now, state = key, program.fresh()
                if block is not None:
                    block.push(*given)
                    at.append(i)
                    what.append(TODO)
                    out.append((None,) * len(made))
                    continue
                state, found = program.step(state, *given)
                if found is not None:
                    at.append(i)
                    what.append(DONE)
                    out.append(found)
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in [*kept, *carried]]
            columns += [pa.array([row[n] for row in out], KINDS[k]) for n, k in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(at), pa.int32()), pa.array(what, pa.int32()), pa.nulls(len(at), pa.binary())], names=names)
            for before, packed in closed:
                last = before
                yield record(SUMMARY, packed)
            last = batch.slice(batch.num_rows - 1, 1)
        if last is not None:
            yield record(SUMMARY, block.packed()) if block is not None else record(STATE, state)

    def composed() -> Callable:
        state = program.fresh()

        def push(what: int, blob: bytes) -> tuple | None:
            nonlocal state
            if what == STATE:
                state = pickle.loads(blob)
                return None
            before, state = state, program.after(pickle.loads(blob), state)
            return (pickle.dumps(before),)

        return push

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            at, out = [], []
            for i, (part, begun, given) in enumerate(zip(batch.column("_part").to_pylist(), batch.column("_state").to_pylist(), zip(*(batch.column(c).to_pylist() for c in inputs)))):
                if part != now:
                    now, state = part, pickle.loads(begun)
                state, found = program.step(state, *given)
                if found is not None:
                    at.append(i)
                    out.append(found)
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([row[n] for row in out], KINDS[k]) for n, k in enumerate(made.values())]], names=[*kept, *made])

    table = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(first_pass, schema))
    records = table.where(F.col("_what").isin(SUMMARY, STATE))
    # one row for each part of the shuffle at most
    states = in_order(records, keys, ["_part"], ["_what", "_blob"], {"_state": "binary"}, composed).select("_part", "_state")
    todo = table.where(F.col("_what") == TODO).join(F.broadcast(states), "_part").repartition("_part").sortWithinPartitions("_part", *order)
    rest = todo.mapInArrow(second_pass, StructType([*[nullable(rows.schema[c]) for c in kept], *extra]))
    return table.where(F.col("_what") == DONE).select(*kept, *made).unionByName(rest)
