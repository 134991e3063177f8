"""URL filter: a blocked Bloom filter before an exact hash join. DataFrame functions only.

Rules are canonical URLs (host, path) with a verdict. A rule fits its host and all subdomains if the
URL's path starts with the rule's; the longest rule wins (host and path together, then the longer
host). Each URL's candidates are its host's suffixes with its path's prefixes, of the shapes (labels,
path length) that rules have. The Bloom filter, in which a key's bits all lie in one 256-bit block,
drops nearly all candidates before any shuffle; what it passes is joined with the rules exactly, so its
false positives have no effect.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule. With no
rules every URL has the default verdict. Rules that occur twice count once; of two verdicts for one
rule ``block`` wins. Repeated rows give repeated rows; a null id is kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 32 bytes in the filter at most: what is sent to every task stays under 8 MB.
MAX_BLOCKS = 1 << 18
#: A rule list of more rows than this is joined by shuffle, not broadcast.
MAX_BROADCAST_RULES = 100_000
#: Copies of a rule in that shuffle, so that a rule that fits a third of all URLs isn't one task's.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path)."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """One row, one column: an array of blocks, each WORDS 64-bit words; rules has a column key."""
    set_bits = [F.bit_or(F.expr(f"shiftleft(1L, b{w})")).alias(f"w{w}") for w in range(WORDS)]
    filled = rules.select(_block(F.col("key"), blocks).alias("block"), *[_bit(F.col("key"), w).alias(f"b{w}") for w in range(WORDS)]).groupBy("block").agg(*set_bits)
    every = rules.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    words = F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(WORDS)])
    dense = every.join(filled, "block", "left").agg(F.sort_array(F.collect_list(F.struct("block", words.alias("words")))).alias("all"))
    return dense.select(F.transform("all", lambda x: x["words"]).alias("filter"))


def may_be_listed(key: Column, filter_array: Column, blocks: int) -> Column:
    """Whether all bits of the key are set in its block."""
    words = F.get(filter_array, _block(key, blocks))
    found = F.lit(True)
    for w in range(WORDS):
        found = found & (F.call_function("shiftrightunsigned", F.get(words, F.lit(w)), _bit(key, w)).bitwiseAND(F.lit(1)) == 1)
    return found


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (host and path of the rule, or null) and verdict for each row. rules: host, path, verdict."""
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    listed = rules.select(F.concat("host", "path").alias("key"), F.col("host").alias("rule_host"), F.length("path").alias("plen"), F.size(F.split("host", r"\.")).alias("labels"), "verdict")
    listed = listed.where("rule_host <> ''").groupBy("key", "rule_host", "plen", "labels").agg(F.max_by("verdict", F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("verdict"))
    count = listed.count()
    blocks = 64
    while blocks < min(MAX_BLOCKS, count // 8):
        blocks *= 2
    shapes = listed.select("labels", "plen").distinct().agg(F.collect_list(F.struct("labels", "plen"))).scalar()
    bits = bloom_filter(listed, blocks).scalar()

    labels = F.split("host", r"\.")
    rows = parts.withColumn("_labels", labels).withColumn("_listed", shapes)
    rows = rows.withColumn("_shapes", F.filter("_listed", lambda s: (s["labels"] <= F.size("_labels")) & (s["plen"] <= F.length("path"))))
    keys = F.transform("_shapes", lambda s: F.concat(F.array_join(F.slice(F.col("_labels"), F.size("_labels") - s["labels"] + 1, s["labels"]), "."), F.substring(F.col("path"), F.lit(1), s["plen"])))
    tried = rows.select("_id", "host", "path", F.posexplode_outer(keys).alias("_pos", "_candidate"))
    # what the filter drops has no key, and so meets no rule
    asked = tried.select("_id", "host", "path", "_pos", F.when(may_be_listed(F.col("_candidate"), bits, blocks), F.col("_candidate")).alias("key"))
    names = listed.select("key", F.length("rule_host").alias("_hosts"), F.col("verdict").alias("_verdict"))
    if count <= MAX_BROADCAST_RULES:
        met = asked.join(F.broadcast(names), "key", "left")
    else:
        salt = F.pmod(F.xxhash64("_id", "_pos"), F.lit(SALTS))
        salted = names.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = asked.withColumn("_salt", salt).join(salted, ["key", "_salt"], "left")
    best = F.max(F.when(F.col("_verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.col("_hosts").alias("h"), F.col("key").alias("rule"), F.col("_verdict").alias("verdict"))))
    judged = met.groupBy("_id", "host", "path").agg(best.alias("best"), F.sum(F.when(F.coalesce("_pos", F.lit(0)) == 0, 1).otherwise(0)).cast("int").alias("_copies"))
    out = judged.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_copy"))
    return out.drop("_copy")
