"""Vector codes: product quantisation in whole numbers, its codebooks trained by Yinyang Lloyd.

A vector's components become floor(SCALE * x); the vector is cut into equal parts, and each part has the
index of its codebook's nearest entry. Entries of a codebook are clustered into groups. A row keeps, for
each part, an upper bound of the distance to its entry and for each group a lower bound of the distance
to the group's other entries; after entries have moved, bounds are widened by their drift and only groups
whose bound fails are scanned. Bounds are floats with a margin, what they can't decide is decided by exact
distances in whole numbers: ties go to the lower index, as in a full scan.

A round is one pass over the rows in Arrow batches, which writes the rows' new state and the sums by
part and entry of each task; Spark adds these up, and the driver holds the codebooks (parts x entries).

Defined results: rows whose vector is null or has null, NaN or infinite components are left out; shorter
vectors are padded with zeros to the longest one's length, rounded up to a multiple of the parts;
fewer rows than entries make smaller codebooks; repeated rows count as often as they occur, rows without
an id come last; components are exact up to +-LIMIT and count as that beyond it; errors beyond 64 bits
are 2^63 - 1; an empty table gives no rows. Ids and labels pass through untouched, whatever their types.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cadenza.llm.store import discard, materialized

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
#: The largest absolute component; up to SMALL, distances of parts fit into 64 bits whatever their length up to 2^10.
LIMIT, SMALL = 10**30, 2**26
MOST = 2**63 - 1
#: What bounds must differ by, relative and absolute, to rule a group out.
RELATIVE, ABSOLUTE = 1e-9, 1e-6
#: Rows of a batch that are held as arrays at once.
ROWS = 4096


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, entries, length) whole numbers (objects if any is large); groups: each entry's group by part."""

    entries: np.ndarray
    groups: np.ndarray

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def whole_numbers(vectors: list[list[float]], length: int) -> np.ndarray:
    """floor(SCALE * x), padded with zeros: int64 where all are SMALL, else Python's integers."""
    x = np.zeros((len(vectors), length))
    for row, v in enumerate(vectors):
        x[row, : len(v)] = v
    floors = np.floor(x * SCALE)
    if not floors.size or np.abs(floors).max() <= SMALL:
        return floors.astype(np.int64)
    return np.array([[max(-LIMIT, min(LIMIT, int(v))) for v in row] for row in floors.tolist()], object)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """(parts, entries): groups of the entries of each codebook, by a few rounds of k-means from entries far apart. Any grouping gives the same codes."""
    out = np.zeros(entries.shape[:2], np.int64)
    for part, e in enumerate(entries.astype(float)):
        centres = e[[0]]
        while len(centres) < min(groups, len(e)):
            apart = ((e[:, None] - centres[None]) ** 2).sum(2).min(1)
            centres = np.concatenate([centres, e[[int(apart.argmax())]]])
        for _ in range(5):
            of = ((e[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([e[of == g].mean(0) if (of == g).any() else c for g, c in enumerate(centres)])
        out[part] = of
    return out


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    if x.dtype == object or entry.dtype == object:
        return ((x.astype(object) - entry.astype(object)) ** 2).sum(-1)
    return ((x - entry) ** 2).sum(-1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


def full_scan(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds by group) of each row and part, by all distances. x: (rows, parts, length)."""
    parts, k = books.groups.shape
    width = int(books.groups.max()) + 1
    code, upper, lower = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2]), np.full((*x.shape[:2], width), np.inf)
    for p in range(parts):
        d = np.stack([squared(x[:, p], books.entries[p, j]) for j in range(k)], 1)
        code[:, p] = d.argmin(1)  # the first of equal ones
        own = np.arange(len(x)), code[:, p]
        upper[:, p] = _root(d[own])
        far = _root(d)
        far[own] = np.inf
        for g in range(width):
            members = books.groups[p] == g
            if members.any():
                lower[:, p, g] = far[:, members].min(1)
    return code, upper, lower


def rescan(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks, drift: np.ndarray) -> int:
    """Moves code, upper and lower (changed in place) to entries that have moved by drift (parts, entries). Returns how many (row, group) pairs were scanned."""
    parts, k = books.groups.shape
    scanned = 0
    for p in range(parts):
        of = books.groups[p]
        upper[:, p] += drift[p][code[:, p]]
        for g in range(lower.shape[2]):
            if (of == g).any():
                lower[:, p, g] -= drift[p][of == g].max()
        sure = lambda u, low: low > u * (1 + RELATIVE) + ABSOLUTE
        rows = np.flatnonzero(~sure(upper[:, p], lower[:, p].min(1)))
        if not len(rows):
            continue
        held = code[rows, p]
        best = squared(x[rows, p], books.entries[p][held])
        exact, at = best.copy(), held.copy()
        upper[rows, p] = _root(best)
        todo = ~sure(upper[rows, p][:, None], lower[rows, p])
        seen = []
        for g in range(lower.shape[2]):
            members, within = np.flatnonzero(of == g), np.flatnonzero(todo[:, g])
            if not len(members) or not len(within):
                continue
            scanned += len(within)
            d = np.stack([squared(x[rows[within], p], books.entries[p, j]) for j in members], 1)
            seen.append((g, members, within, d))
            for n, j in enumerate(members):
                closer = (d[:, n] < best[within]) | ((d[:, n] == best[within]) & (j < at[within]))
                closer = closer.astype(bool)
                best[within[closer]], at[within[closer]] = d[closer, n], j
        for g, members, within, d in seen:
            far = _root(d)
            far[members[None, :] == at[within][:, None]] = np.inf
            lower[rows[within], p, g] = far.min(1)
        # an entry that a row has left bounds its group, unless that group was scanned
        left = np.flatnonzero((at != held) & ~todo[np.arange(len(rows)), of[held]])
        lower[rows[left], p, of[held[left]]] = np.minimum(lower[rows[left], p, of[held[left]]], _root(exact[left]))
        code[rows, p], upper[rows, p] = at, _root(best)
    return scanned


STATE = "ints binary, code binary, upper binary, lower binary, sums array<string>"


def _frozen(x: np.ndarray) -> list[bytes]:
    """A row's components: 4 bytes each where they are small, else their decimals."""
    if x.dtype == object:
        return [b"," + ",".join(map(str, row)).encode() for row in x.reshape(len(x), -1).tolist()]
    return [b"i" + row.tobytes() for row in x.reshape(len(x), -1).astype("<i4")]


def _thawed(raw: list[bytes], parts: int) -> np.ndarray:
    if any(r[:1] == b"," for r in raw):
        rows = [list(map(int, r[1:].split(b","))) if r[:1] == b"," else np.frombuffer(r, "<i4", offset=1).tolist() for r in raw]
        x = np.empty((len(rows), len(rows[0])), object)
        x[:] = rows
    else:
        x = np.array([np.frombuffer(r, "<i4", offset=1) for r in raw]).astype(np.int64)
    return x.reshape(len(raw), parts, -1)


class _Sums:
    """Sums of parts and their counts by (part, entry): exact, whatever the size."""

    def __init__(self, books: Codebooks):
        self.total = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), object)

    def add(self, x: np.ndarray, code: np.ndarray) -> None:
        for p in range(x.shape[1]):
            for j in np.unique(code[:, p]):
                mine = x[code[:, p] == j, p]
                self.total[p, j, :-1] += mine.sum(0).astype(object)
                self.total[p, j, -1] += len(mine)


def _round(rows: DataFrame, books: Codebooks, before: Codebooks | None, length: int) -> DataFrame:
    """kept and STATE after one assignment: the first scans all entries, later ones what the bounds leave open. A row without kept's values has a task's sums."""
    drift = None if before is None else _root(squared(books.entries, before.entries)) * (1 + RELATIVE) + ABSOLUTE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kind, width = _Sums(books), None, int(books.groups.max()) + 1
        for whole in batches:
            kind = whole.schema.field("kept").type
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                n = batch.num_rows
                if before is None:
                    x = whole_numbers(batch.column("vector").to_pylist(), length).reshape(n, PARTS, -1)
                    code, upper, lower = full_scan(x, books)
                else:
                    x = _thawed(batch.column("ints").to_pylist(), PARTS)
                    read = lambda c, t: np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, PARTS, -1)  # noqa: E731, B023
                    code, upper, lower = read("code", np.uint8)[:, :, 0].astype(np.int64), read("upper", "<f8")[:, :, 0].copy(), read("lower", "<f8").copy()
                    rescan(x, code, upper, lower, books, drift)
                sums.add(x, code)
                state = [_frozen(x), [r.tobytes() for r in code.astype(np.uint8)], [r.tobytes() for r in upper.astype("<f8")], [r.tobytes() for r in lower.astype("<f8").reshape(n, PARTS * width)]]
                yield pa.RecordBatch.from_arrays([batch.column("kept"), *[pa.array(s, pa.binary()) for s in state], pa.nulls(n, pa.list_(pa.string()))], names=["kept", "ints", "code", "upper", "lower", "sums"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, pa.binary())] * 4, pa.array([[str(v) for v in sums.total.ravel()]], pa.list_(pa.string()))], names=["kept", "ints", "code", "upper", "lower", "sums"])

    kept = StructField("kept", rows.schema["kept"].dataType, True)
    return rows.mapInArrow(run, StructType([kept, *StructType.fromDDL(STATE).fields]))


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the floors of their parts' means; entries without parts stay."""
    # a decimal sum holds 38 digits: sums are added in limbs of 15 digits, with their sign
    limbs = state.where("sums is not null").select(F.posexplode("sums").alias("at", "text")).withColumn("sign", F.when(F.col("text").startswith("-"), -1).otherwise(1)).withColumn("text", F.lpad(F.ltrim(F.col("text"), F.lit("-")), 75, "0"))
    parts = [F.sum(F.col("sign") * F.substring("text", 1 + 15 * i, 15).cast("long").cast("decimal(20,0)")).alias(f"l{i}") for i in range(5)]
    total = np.zeros(books.entries.shape[0] * books.entries.shape[1] * (books.entries.shape[2] + 1), object)
    for r in limbs.groupBy("at").agg(*parts).collect():
        total[r["at"]] = sum(int(r[f"l{i}"]) * 10 ** (15 * (4 - i)) for i in range(5))
    total = total.reshape(*books.entries.shape[:2], -1)
    made = books.entries.astype(object).copy()
    for p, j in np.ndindex(*made.shape[:2]):
        if total[p, j, -1]:
            made[p, j] = [v // total[p, j, -1] for v in total[p, j, :-1]]
    return Codebooks(_compact(made), books.groups)


def _compact(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if all(abs(v) <= SMALL for v in entries.ravel().tolist()) else entries


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> DataFrame:
    """id, label, code (two hex digits a part), error, label_error, codebooks_sha256 of each vector that is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    vector = vectors[f"`{vector_col}`"].cast("array<double>")
    whole = vectors.select(F.struct(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{label_col}`"].alias("label")).alias("kept"), vector.alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = whole.where(F.col("vector").isNotNull() & ~odd)
    longest = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    kinds = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}"
    if longest is None:
        return spark.createDataFrame([], f"{kinds}, label {vectors.schema[label_col].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    length = PARTS * max(1, -(-longest // PARTS))
    first = rows.orderBy(F.col("kept.id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = whole_numbers([r["vector"] for r in first], length).reshape(len(first), PARTS, -1).transpose(1, 0, 2)
    books, before = Codebooks(np.ascontiguousarray(start), grouped(start, groups)), None
    state = materialized(_round(rows, books, None, length))
    for _ in range(rounds):
        before, books = books, _moved(state, books)
        older, state = state, materialized(_round(state.where("sums is null"), books, before, length))
        discard(older)
    digest = F.lit(sha256(books.text().encode()).hexdigest())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _thawed(batch.column("ints").to_pylist(), PARTS), batch.column("code").to_pylist()
            at = np.frombuffer(b"".join(code), np.uint8).reshape(-1, PARTS)
            errors = sum(squared(x[:, p], books.entries[p][at[:, p]]).astype(object) for p in range(PARTS))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array([c.hex() for c in code]), pa.array([min(MOST, int(e)) for e in errors], pa.int64())], names=["kept", "code", "error"])

    schema = StructType([state.schema["kept"], *StructType.fromDDL("code string, error long").fields])
    coded = materialized(state.where("sums is null").select("kept", "ints", "code").mapInArrow(finish, schema).select(F.col("kept.id").alias(id_col), F.col("kept.label").alias("label"), "code", "error"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]))
    discard(state)
    return out.select(id_col, "label", "code", "error", "label_error", digest.alias("codebooks_sha256"))
