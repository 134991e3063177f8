"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Every fingerprint enters the table under its segments' values;
probes are the values in a small Hamming ball around each segment; what a probe meets in the table is
verified by the complete distance. Linked fingerprints form components (alternating large and small
stars), so no group is ever gathered in one place.

Two settings share this:

* ``link_close``: 64-bit fingerprints, every pair within two bits is found (proof at ``exact_keys``).
* ``near_duplicate_groups``: long fingerprints of five-word shingles, whose distance estimates Jaccard
  similarity; pairs near the threshold are settled by their exact similarity. Short texts, whose
  fingerprints say less, also have keys by which every similar pair of them meets.

Defined results: a null text is an empty text; texts without words have fingerprint zero and link to
each other. Ties and repeated rows share a fingerprint and so a component. A null id is kept and has
the smallest non-null id of its component (null where there is none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrow import kept_with, mapped
from cadenza.llm.store import materialized

#: Shingles hashed at a time: bounds memory for very long texts.
SLICE = 100_000


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle of a lower-cased text, in slices; the whole sequence if it has fewer words."""
    found = (text or "").encode().lower().split()
    if not found:
        return
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        yield np.array([hashed(joined, 42)], np.uint64)
        return
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    last = np.cumsum(lengths + 1) - 1
    first, last = last - lengths, last[words - 1 :]
    for lo in range(0, len(last), SLICE):
        pairs = zip(first[lo : lo + SLICE].tolist(), last[lo : lo + SLICE].tolist())
        yield np.array([hashed(joined[i:j], 42) for i, j in pairs], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of (n, words) 64-bit hashes have each bit."""
    raw, total = hashes.view(np.uint8).reshape(len(hashes), -1), 0
    for lo in range(0, len(raw), 255):
        total = total + np.unpackbits(raw[lo : lo + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8).astype(np.int64)
    return total


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (long): a bit is 1 if over half of the shingles' hashes have it."""

    def made(texts: list) -> dict:
        out = np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            counts, n = np.zeros(64, np.int64), 0
            for hashes in shingle_hashes(text, words):
                counts += bit_counts(hashes[:, None])
                n += len(hashes)
            out[row] = np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0]
        return {"fp": out}

    return mapped(kept_with(docs, [id_col], text=F.col(text_col)), ["text"], {"fp": "long"}, made).select("kept.*", "fp")


def exact_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table keys, probe keys) of 64-bit fingerprints, as (n, 8) and (n, 38 or less, padded with -1).

    With halves A and B, two fingerprints within two bits differ in (A, B) by one of
    (0, <= 2): A agrees, and of three parts of B one agrees: both have the key (A, that part);
    (<= 2, 0): the same with A and B exchanged;
    (1, 1): the one that has a 0 where the other's A has a 1 probes with that bit set, and of the two
    parts of B one agrees: its probe (A with the bit, that part) is the other's table key.
    A key is exact: 3 bits of kind, 32 of the half, up to 16 of the part.
    """
    a, b = fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF)
    key = lambda kind, half, part: (np.uint64(kind) << np.uint64(48)) | (half << np.uint64(16)) | part
    thirds = lambda x: (x & np.uint64(0x7FF), (x >> np.uint64(11)) & np.uint64(0x7FF), x >> np.uint64(22))
    halves = (b & np.uint64(0xFFFF), b >> np.uint64(16))
    equal = [key(k, a, p) for k, p in enumerate(thirds(b))] + [key(3 + k, b, p) for k, p in enumerate(thirds(a))]
    table = np.stack(equal + [key(6 + k, a, p) for k, p in enumerate(halves)], 1)
    balls = []
    for bit in range(32):
        flag = np.uint64(1 << bit)
        for k, p in enumerate(halves):
            balls.append(np.where(a & flag == 0, key(6 + k, a | flag, p), ~np.uint64(0)))
    return table.view(np.int64), np.concatenate([table[:, :6], np.stack(balls, 1)], 1).view(np.int64)


def close_pairs(found: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): all pairs of different fingerprints in column fp (each once) within two bits."""
    if not 0 <= distance <= 2:
        raise ValueError("the keys are complete for distances of 0 to 2")

    def keyed(batches: Iterator[pd.DataFrame], which: int) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            keys = exact_keys(fp.view(np.uint64))[which]
            keep = keys != -1
            yield pd.DataFrame({"key": keys[keep], "fp": np.repeat(fp, keep.sum(1))})

    table = found.select("fp").mapInPandas(lambda x: keyed(x, 0), "key long, fp long")
    probes = found.select("fp").mapInPandas(lambda x: keyed(x, 1), "key long, fp long").withColumnRenamed("fp", "a")
    met = probes.join(table.withColumnRenamed("fp", "b").hint("merge"), "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches; alternates large and small stars until only stars are left.

    The least neighbours come from partial aggregates and are written, so that both sides of their join
    are plain exchanges: Spark splits a star's centre over several tasks.
    """
    now = materialized(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialized(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = materialized(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = materialized(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = materialized(small.where("a != b").distinct())
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def link_close(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id (the smallest id reachable over links of at most distance bits) for each row."""
    rows = materialized(fingerprints(docs, words, id_col, text_col))
    classes = materialized(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(close_pairs(classes, distance))
    joined = materialized(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    whole = materialized(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.join(joined.join(whole, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# Long fingerprints: near-duplicates by Jaccard similarity.

LONG_WORDS = 32
SEGMENT = 24
#: Keys come from the first half of the bits; the whole fingerprint decides.
SEGMENTS = LONG_WORDS * 64 // 2 // SEGMENT
#: The least certain bits of a segment, each flipped in a probe of its own.
FLIPS = 3
#: Segments of the first pass, which joins most of a crowd before its members meet each other.
FIRST_SEGMENTS = 8
#: Texts of at most so many different shingles also have keys by which every similar pair of them meets.
SHORT = 30
#: Rows of a side that meet in one block of a table entry.
BLOCK = 2000
#: More keys than this are joined by shuffle, not broadcast.
MAX_BROADCAST_KEYS = 1_000_000


def expected_distance(similarity: float, bits: int = LONG_WORDS * 64) -> float:
    """Bits that differ, on average, at a Jaccard similarity of two large sets of one size."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def _spread(hashes: np.ndarray) -> np.ndarray:
    """(n, LONG_WORDS): independent 64-bit hashes from one."""
    x = hashes[:, None] + np.arange(1, LONG_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    slices = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(slices)) if slices else np.zeros(0, np.uint64)


def long_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(LONG_WORDS 64-bit words, places of each segment's least certain bits); each different shingle votes once."""
    votes = np.zeros(LONG_WORDS * 64, np.int64)
    for lo in range(0, len(hashes), 4096):
        votes += bit_counts(_spread(hashes[lo : lo + 4096]))
    margin = np.abs(2 * votes - len(hashes))[: SEGMENTS * SEGMENT].reshape(SEGMENTS, SEGMENT)
    weak = np.argsort(margin, axis=1, kind="stable")[:, :FLIPS].astype(np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64), weak.tobytes()


def short_keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Of a text of few shingles, those of which similar ones must have one in common: its smallest hashes, as negative keys."""
    if not 0 < len(hashes) <= SHORT:
        return np.zeros(0, np.int64)
    some = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return (hashes[:some] | np.uint64(1 << 63)).view(np.int64)


def long_keys(fps: np.ndarray, weak: list[bytes]) -> np.ndarray:
    """(n, 1 + FLIPS, SEGMENTS): keys of the segments, then of the segments with one weak bit flipped."""
    bits = np.unpackbits(np.ascontiguousarray(fps[:, : LONG_WORDS // 2]).view(np.uint8), axis=1, bitorder="little")
    bits = bits[:, : SEGMENTS * SEGMENT].reshape(len(fps), SEGMENTS, SEGMENT)
    value = (bits.astype(np.int64) << np.arange(SEGMENT)).sum(2)
    flips = np.int64(1) << np.frombuffer(b"".join(weak), np.uint8).reshape(len(fps), SEGMENTS, FLIPS).astype(np.int64)
    keys = np.concatenate([value[:, None], value[:, None] ^ flips.transpose(0, 2, 1)], 1)
    return keys | (np.arange(SEGMENTS, dtype=np.int64) << 32)


def jaccard(a: str | None, b: str | None, words: int) -> float:
    x, y = distinct_shingles(a, words), distinct_shingles(b, words)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs written once with a number for each row, that column's name): ids may be null or repeated, numbers are neither."""
    row = "_row".ljust(1 + max(map(len, docs.columns)), "_")
    return materialized(docs.withColumn(row, F.monotonically_increasing_id())), row


@dataclass(frozen=True)
class Limits:
    """Distances, in bits, of pairs of the similarity that is asked for: all but one in a thousand lie between sure and far."""

    sure: float
    far: float
    #: As far, for two short texts: their sizes' parity puts them further apart than large sets.
    short_far: float
    #: As far and short_far (four deviations), of the 64 bits of a sketch.
    sketch: int
    short_sketch: int

    @classmethod
    def of(cls, similarity: float) -> Limits:
        bits, middle = LONG_WORDS * 64, expected_distance(similarity)
        share, short = middle / bits, 1.25 * middle / bits
        off = lambda p, n, times: n * p + times * math.sqrt(n * p * (1 - p))
        return cls(off(share, bits, -3), off(share, bits, 3), off(short, bits, 4), int(off(share, 64, 4)), int(off(short, 64, 4)))


def bits_apart(a: str, b: str) -> Column:
    """Between the fingerprints in two columns."""
    return sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(LONG_WORDS))


def duplicate_classes(docs: DataFrame, row_col: str, words: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, id and fp of each row; fp, best and group of each different fingerprint).

    best is the class's row that comes first by (id, hash of the text, row), rows without an id last; its
    number stands for the class, and group is the smallest number that it reaches.

    First every probe of a few segments meets one member of its table entry, that of the smallest number:
    pairs stay in proportion to documents, and what they join is one group from then on. Then all
    segments: every probe meets every member of another group (but for those of an entry's first group,
    which the others probe). Distances far from the threshold decide at once; in between, three standard
    deviations to either side, the texts' exact similarity does.
    """
    limits = Limits.of(similarity)
    own = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))

    def made(texts: list) -> dict:
        found = [distinct_shingles(t, words) for t in texts]
        prints = [long_fingerprint(x) for x in found]
        return {"fp": [fp.tolist() for fp, _ in prints], "weak": [w for _, w in prints], "short": [short_keys(x, similarity).tolist() for x in found]}

    rows = materialized(mapped(own, ["text"], {"fp": "array<long>", "weak": "binary", "short": "array<long>"}, made))
    # equal fingerprints are one class from here on
    firsts = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tie", "row", "weak", "short")).alias("m"))
    # in as many parts as shuffles have: each class makes a hundred keys and more
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = materialized(firsts.repartition(parts, "fp").select(F.col("m.row").alias("node"), "fp", F.col("m.weak").alias("weak"), F.col("m.short").alias("short"), F.struct("m.last", "m.id", "m.tie", "m.row").alias("best"), F.col("m.row").alias("group")))
    texts = docs.select(F.col(row_col).alias("node"), F.col(text_col).alias("text"))

    def keys_of(segments: int, kinds: int) -> DataFrame:
        """key, node, group, sketch, short, member: the keys of the first segments; member for the table's, else a probe's."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), 2000):
                    part = batch.slice(lo, 2000)
                    fps = np.stack(part["fp"].to_numpy(zero_copy_only=False))
                    keys = long_keys(fps, part["weak"].to_pylist())[:, :kinds, :segments].reshape(len(fps), -1)
                    extra = part["short"].to_pylist()
                    each = np.concatenate([np.repeat(np.arange(len(fps)), keys.shape[1]), np.repeat(np.arange(len(fps)), [len(x) for x in extra])])
                    few = np.zeros(len(each), bool)
                    few[keys.size :] = True
                    member = np.concatenate([np.tile(np.arange(keys.shape[1]) < segments, len(fps)), few[keys.size :]])
                    flat = np.concatenate([keys.ravel(), np.array([x for one in extra for x in one], np.int64)])
                    columns = [flat, part["node"].to_numpy()[each], part["group"].to_numpy()[each], fps[each, LONG_WORDS // 2], few, member]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "group", "sketch", "short", "member"])

        return classes.select("node", "fp", "weak", "short", "group").mapInArrow(run, "key long, node long, group long, sketch long, short boolean, member boolean")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [jaccard(x, y, words) >= similarity for x, y in zip(batch["text"], batch["other_text"])]
            yield batch.loc[keep, ["group", "other_group"]]

    def joined(measured: DataFrame) -> DataFrame:
        """The classes, after those pairs (node, group, other, other_group, distance) that are similar have joined their groups."""
        unsure = measured.where(F.col("distance") > limits.sure)
        asked = materialized(unsure.select("node").union(unsure.select("other")).distinct())
        picked = texts.join(F.broadcast(asked) if asked.count() <= MAX_BROADCAST_KEYS else asked.hint("merge"), "node", "left_semi")
        read = unsure.join(picked.hint("merge"), "node").join(picked.select(F.col("node").alias("other"), F.col("text").alias("other_text")).hint("merge"), "other")
        links = measured.where(F.col("distance") <= limits.sure).select("group", "other_group").unionByName(read.select("group", "other_group", "text", "other_text").mapInPandas(settle, "group long, other_group long"))
        roots = components(links.select(F.col("group").alias("a"), F.col("other_group").alias("b")))
        return materialized(classes.join(roots, classes["group"] == roots["node"], "left").select(classes["node"], "fp", "weak", "short", "best", F.coalesce("root", "group").alias("group")))

    probes, members = keys_of(FIRST_SEGMENTS, 1 + FLIPS), keys_of(FIRST_SEGMENTS, 1)
    first = members.groupBy("key").agg(F.min(F.struct("node", "group", "sketch")).alias("m")).select("key", F.col("m.node").alias("other"), F.col("m.group").alias("other_group"), F.col("m.sketch").alias("other_sketch"))
    # both sides grow with the documents: their size on disk must not lead to a broadcast
    met = probes.join(first.hint("merge"), "key").where((F.col("group") != F.col("other_group")) & near(limits)).select("node", "group", "other", "other_group", "short")
    met = met.groupBy("node", "group", "other", "other_group").agg(F.max("short").alias("short"))
    prints = classes.select("node", "fp")
    seen = met.join(prints.hint("merge"), "node").join(prints.select(F.col("node").alias("other"), F.col("fp").alias("other_fp")).hint("merge"), "other")
    classes = joined(materialized(seen.withColumn("distance", bits_apart("fp", "other_fp")).where(within(limits)).select("node", "group", "other", "other_group", "distance")))
    return rows, joined(materialized(met_in_blocks(keys_of(SEGMENTS, 1 + FLIPS), classes.select("node", "fp"), limits)))


def near(limits: Limits) -> Column:
    """Whether the sketches of two rows may be those of a similar pair."""
    return F.bit_count(F.col("sketch").bitwiseXOR(F.col("other_sketch"))) <= F.when(F.col("short"), limits.short_sketch).otherwise(limits.sketch)


def within(limits: Limits) -> Column:
    """Whether a distance may be that of a similar pair."""
    return F.col("distance") <= F.when(F.col("short"), limits.short_far).otherwise(limits.far)


def met_in_blocks(every: DataFrame, prints: DataFrame, limits: Limits) -> DataFrame:
    """(node, group, other, other_group, distance): each probe with each member of its table entry that is of another group and not too far.

    every: key, node, group, sketch, short, member (of the entry, and not only a probe); prints: node, fp.
    The entry's first group doesn't probe, it is probed by the others. As groups have the number of their
    first member, the first one is mostly the largest: time is in proportion to pairs of different groups
    even if a group fills the entry. An entry's pairs are made in blocks of BLOCK rows a side. Only probes that have a partner of a near sketch (64 bits that no key has), and members of
    their entries, are given their fingerprints, so that chance meetings, whose number grows faster than
    the documents, stay small rows.
    """
    several = materialized(every.groupBy("key").agg(F.min("group").alias("first"), F.max("group").alias("last"), F.count_if("member").alias("members")).where("first != last and members > 0").select("key", "first"))
    live = materialized(every.join(F.broadcast(several) if several.count() <= MAX_BROADCAST_KEYS else several.hint("merge"), "key").where("member or group != first"))
    blocks = live.groupBy("key").agg(F.ceil(F.count_if(F.col("group") != F.col("first")) / BLOCK).alias("left"), F.ceil(F.count_if("member") / BLOCK).alias("right"))
    sized = live.join(blocks.hint("merge"), "key")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    copies = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    probes = sized.where("group != first").select("key", block("left").alias("x"), copies("right").alias("y"), "node", "group", "sketch", "short")
    members = materialized(sized.where("member").select("key", copies("left").alias("x"), block("right").alias("y"), F.col("node").alias("other"), F.col("group").alias("other_group"), F.col("sketch").alias("other_sketch")))
    at = ["key", "x", "y"]
    meet = [probes[c] == members[c] for c in at] + [probes["group"] != members["other_group"], near(limits)]
    probes = materialized(probes.join(members.hint("merge"), meet, "left_semi"))
    members = members.join(probes.select(*at).distinct().hint("merge"), at, "left_semi")
    full = probes.join(prints.hint("merge"), "node")
    other = members.join(prints.select(F.col("node").alias("other"), F.col("fp").alias("other_fp")).hint("merge"), "other")
    met = full.join(other.hint("merge"), at).withColumn("distance", bits_apart("fp", "other_fp")).where((F.col("group") != F.col("other_group")) & within(limits))
    pair = [F.least("node", "other").alias("node"), F.when(F.col("node") < F.col("other"), F.col("group")).otherwise(F.col("other_group")).alias("group"), F.greatest("node", "other").alias("other"), F.when(F.col("node") < F.col("other"), F.col("other_group")).otherwise(F.col("group")).alias("other_group")]
    return met.select(*pair, "distance").distinct()


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and group_id (the smallest non-null id of its group) for each row."""
    docs, row = numbered(docs.select(id_col, text_col))
    rows, classes = duplicate_classes(docs, row, words, similarity, id_col, text_col)
    names = classes.groupBy("group").agg(F.min("best").alias("best")).select("group", F.col("best.id").alias("group_id"))
    named = classes.select("fp", "group").join(names.hint("merge"), "group").select("fp", "group_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "group_id")


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that of the smallest non-null id (of several, the first by its text's hash)."""
    rows, row = numbered(docs)
    _, classes = duplicate_classes(rows, row, words, similarity, id_col, text_col)
    first = classes.groupBy("group").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)
