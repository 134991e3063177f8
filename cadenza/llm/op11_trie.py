"""A prefix trie over conversations, by heavy-path decomposition.

Every different sequence of first turns is a node; a conversation is a member of the nodes it passes
through. A node's largest child (by members; ties: the smallest member) continues its path, all others
start paths of their own, so no conversation meets more than log2(conversations) of these light nodes.
Values of subtrees are suffix sums along each path; a path's total is then attached to the parent of
its first node. That is done level by level (a path's level: light nodes above it), deepest first.

Texts leave the first scan as 128-bit digests. What has to follow a conversation's order (places, prefix
digests, a path's sums) runs in blocks of BLOCK turns, or in the parts of a range shuffle, and is carried
over from block to block in small tables: a conversation of any length is many tasks' work. A prefix is
known by its depth and four exact sums of 32-bit hashes of (digest, place).

Defined results: null role and text are empty; turns are in order of turn, null first, and those of one turn
in order of their digests; repeated rows are turns of their own; rows without a conv_id belong to no
conversation and are left out; an empty table gives no rows, not even a root. conv_id is a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.store import discard, materialized

#: Turns of a conversation, or nodes of a path, that one window holds.
BLOCK = 4096
#: Members whose ids are joined to one chunk of text before it is hashed.
CHUNK = 4096
EMPTY_SHA256 = sha256(b"").hexdigest()


def digested(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, digest (of role and text) and chars (the text's code points) of each row that has a conv_id."""
    role, text = (F.coalesce(conversations[f"`{c}`"].cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(whole, 256), 1, 32))
    return conversations.where(conversations[f"`{conv_col}`"].isNotNull()).select(conversations[f"`{conv_col}`"].cast("long").alias("conv_id"), conversations[f"`{turn_col}`"].alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))


def before(rows: DataFrame, keys: list[str], block: str, sums: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """keys, block and what the earlier blocks of the same keys carry over to a block; none for first blocks."""
    w = Window.partitionBy(*keys).orderBy(block)
    made = rows.groupBy(*keys, block).agg(*[c.alias(n) for n, c in sums.items()])
    found = made.select(*keys, block, F.row_number().over(w).alias("_nth"), *[c.over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, c in carried.items()])
    return found.where("_nth > 1").drop("_nth")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with place: 1, 2, ... in the order of each key; a key may be spread over many parts of a range shuffle."""
    dealt = materialized(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    carry = before(dealt, [key], "_part", {"_n": F.count(F.lit(1))}, {"_carry": F.sum("_n")})
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return dealt.withColumn("_within", within).join(carry, [key, "_part"], "left").withColumn("place", (F.col("_within") + F.coalesce("_carry", F.lit(0))).cast("long")).drop("_within", "_carry", "_part")


def with_shared_heads(turns: DataFrame, of: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, digest, chars of rebuilt conversations; all conv_ids).

    The first h turns of conversation c are those of conversation c - c % of (all it has, if fewer; none, if
    there is no such one); c's own turns after its first h follow. h is crc32 of c in decimals, modulo most + 1.
    """
    own = materialized(numbered(turns, "conv_id", ["turn", "digest"]))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = own.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % of).alias("base"), h.alias("h"))
    heads = own.where((F.col("conv_id") % of == 0) & (F.col("place") <= most)).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    taken = materialized(convs.join(heads, "base").where("place <= h").select("conv_id", "place", "digest", "chars"))
    # where the base has fewer than h turns, own turns move up
    lengths = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    short = convs.join(lengths, "conv_id", "left").select("conv_id", (F.col("h") - F.coalesce("n", F.lit(0))).alias("short")).where("short > 0")
    rest = own.where(F.col("place") > h).join(short, "conv_id", "left").select("conv_id", (F.col("place") - F.coalesce("short", F.lit(0))).alias("place"), "digest", "chars")
    return taken.unionByName(rest), convs.select("conv_id")


def _key(lanes: list[Column], depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[c.cast("string") for c in lanes], depth.cast("string")).cast("binary")))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, chars: the key of each turn's prefix and of the one before it. rows: conv_id, place, digest, chars."""
    low = F.lit(2**32 - 1).cast("long")
    one, two = F.xxhash64("digest", "place"), F.xxhash64(F.lit("second"), "digest", "place")
    lanes = {"_a": one.bitwiseAND(low), "_b": F.shiftrightunsigned(one, 32), "_c": two.bitwiseAND(low), "_d": F.shiftrightunsigned(two, 32)}
    hashed = materialized(rows.select("conv_id", F.col("place").alias("depth"), "chars", F.floor((F.col("place") - 1) / BLOCK).cast("int").alias("block"), *[c.alias(n) for n, c in lanes.items()]))
    carry = before(hashed, ["conv_id"], "block", {n: F.sum(n) for n in lanes}, {f"{n}0": F.sum(n) for n in lanes})
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select("conv_id", "block", "depth", "chars", *lanes, *[F.sum(n).over(w).alias(f"{n}1") for n in lanes]).join(carry, ["conv_id", "block"], "left")
    upto = [F.col(f"{n}1") + F.coalesce(f"{n}0", F.lit(0)) for n in lanes]
    return summed.select("conv_id", "depth", _key(upto, F.col("depth")).alias("node"), _key([u - F.col(n) for u, n in zip(upto, lanes)], F.col("depth") - 1).alias("parent"), "chars")


def digests_of_members(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: of the node's ids (column conv_id) in ascending order, comma-joined. Ids become chunks of text in the parts of a range shuffle; a node's chunks are then hashed in order."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held = None, None, []
        out: list[tuple] = []

        def close() -> None:
            if held:
                out.append((node, first, ",".join(map(str, held))))

        for batch in batches:
            for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if own != node or len(held) >= CHUNK:
                    close()
                    node, first, held = own, conv, []
                held.append(conv)
            yield _batch(out, ("node", "first", "ids"), (pa.binary(), pa.int64(), pa.string()))
            out.clear()
        close()
        yield _batch(out, ("node", "first", "ids"), (pa.binary(), pa.int64(), pa.string()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if own != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = own, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(out, ("node", "ends_sha256"), (pa.binary(), pa.string()))
        if state is not None:
            yield _batch([(node, state.hexdigest())], ("node", "ends_sha256"), (pa.binary(), pa.string()))

    chunks = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    rows: conv_id, place (1, 2, ... without gaps), digest, chars; convs: every conv_id once, those without turns too.
    saved_tokens: over a node's subtree, (n_convs - 1) times the code points of each node's last text.
    """
    spark = rows.sparkSession
    passed = materialized(prefixes(rows))
    whole = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    if not whole["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = spark.range(1).select(_key([F.lit(0)] * 4, F.lit(0)).alias("node"))
    key = root.first()["node"]
    is_root = F.lit(bytearray(key))

    nodes = passed.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"))
    nodes = materialized(nodes)
    families = materialized(nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.max_by("node", F.struct("n_convs", -F.col("owner"))).alias("heavy")))
    known = nodes.join(families.select(F.col("parent").alias("node"), "n_children"), "node", "left").join(families.select(F.col("heavy").alias("node"), F.lit(False).alias("light")), "node", "left")
    known = materialized(known.select("node", "owner", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("light", F.lit(True)).alias("light")))

    # each conversation walks down its nodes: the last light one begins the path that it is on
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("int")
    walked = materialized(passed.join(known, "node").withColumn("block", block))
    carry = before(
        walked, ["conv_id"], "block",
        {"_head": F.expr("max_by(node, depth) filter (where light)"), "_lights": F.sum(F.col("light").cast("long")), "_owner": F.max_by("owner", "depth")},
        {"_head0": F.last("_head", ignorenulls=True), "_lights0": F.sum("_lights"), "_owner0": F.last("_owner")},
    )
    w = Window.partitionBy("conv_id", "block").orderBy("depth")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    walk = walked.select("*", F.last(F.when(F.col("light"), F.col("node")), ignorenulls=True).over(upto).alias("_head"), F.sum(F.col("light").cast("long")).over(upto).alias("_lights"), F.lag("owner").over(w).alias("_above")).join(carry, ["conv_id", "block"], "left")
    placed = walk.where("conv_id = owner").select(
        "node", "parent", "owner", "depth", "n_convs", "n_children", F.coalesce("_head", "_head0", is_root).alias("head"), (F.col("_lights") + F.coalesce("_lights0", F.lit(0))).cast("int").alias("level"),
        F.coalesce("_above", "_owner0", F.lit(whole["least"])).alias("parent_conv_id"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    top = families.where(F.col("parent") == is_root).agg(F.coalesce(F.max("n_children"), F.lit(0)).alias("n")).first()["n"]
    long = lambda x: F.lit(x).cast("long")
    rooted = root.select("node", F.lit(None).cast("binary").alias("parent"), long(whole["least"]).alias("owner"), long(0).alias("depth"), long(whole["n"]).alias("n_convs"), long(top).alias("n_children"), F.col("node").alias("head"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent_conv_id"), long(0).alias("saved"))
    placed = materialized(placed.unionByName(rooted).withColumn("leaf", (F.col("n_children") == 0).cast("long")), partition_by="level")

    finished, attached = [], None
    for level in range(placed.agg(F.max("level")).first()[0], -1, -1):
        own = placed.where(F.col("level") == level)
        if attached is not None:
            own = own.join(attached, "node", "left").withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).withColumn("leaf", F.col("leaf") + F.coalesce("more_leaves", F.lit(0)))
        done = materialized(suffix_sums(own.select("node", "parent", "head", "depth", "saved", "leaf")))
        finished.append(done.select("node", "n_leaves", "saved_tokens"))
        heads = done.where(F.col("node") == F.col("head"))
        attached = heads.groupBy(F.col("parent").alias("node")).agg(F.sum("saved_tokens").alias("more_saved"), F.sum("n_leaves").alias("more_leaves"))

    sums = finished[0]
    for other in finished[1:]:
        sums = sums.unionByName(other)
    last = passed.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = digests_of_members(convs.join(last, "conv_id", "left").select(F.coalesce("node", is_root).alias("node"), "conv_id"))
    result = materialized(placed.join(sums, "node").join(ends, "node", "left").select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")))
    discard(passed, nodes, families, known, walked, placed, *finished)
    return result


def suffix_sums(rows: DataFrame) -> DataFrame:
    """rows with saved_tokens and n_leaves: sums of saved and leaf from each node to its path's end, in blocks of the path's array."""
    cut = rows.withColumn("block", -F.floor(F.col("depth") / BLOCK).cast("int"))
    carry = before(cut, ["head"], "block", {"_s": F.sum("saved"), "_l": F.sum("leaf")}, {"_s0": F.sum("_s"), "_l0": F.sum("_l")})
    w = Window.partitionBy("head", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select("*", F.sum("saved").over(w).alias("_s1"), F.sum("leaf").over(w).alias("_l1")).join(carry, ["head", "block"], "left")
    return summed.select("node", "parent", "head", (F.col("_s1") + F.coalesce("_s0", F.lit(0))).alias("saved_tokens"), (F.col("_l1") + F.coalesce("_l0", F.lit(0))).alias("n_leaves"))
