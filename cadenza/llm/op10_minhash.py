"""Document fingerprints: one-permutation MinHash. DataFrame functions only.

Each shingle of five words is hashed once; its hash's top bits choose a bin and each bin keeps its
smallest hash. An empty bin borrows from a bin that a shared random sequence of its own finds first
(optimal densification). A fingerprint has the low-order bits of each bin; likeness corrects for bins
that agree by chance.

Defined results: a null text is an empty text; a text of fewer words than a shingle is one shingle,
an empty one the empty shingle. Ties in the order of documents are broken by a hash of the text.
Repeated rows give repeated rows (the next document may then be a copy). Null ids come last. Ids are
numbers; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.store import materialized

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
#: Attempts of the shared sequence before the whole rest of it is decided at once.
ATTEMPTS = 12
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text of a bucket of neighbours: small ones until all cores have several, then large ones, as many as it takes.
BUCKET_BYTES, LARGE_BUCKET_BYTES = 8_000_000, 256_000_000
#: Of the ids, from which the buckets' bounds follow.
QUANTILES = 128
#: More buckets than this are joined by shuffle, not broadcast.
MAX_BROADCAST_BUCKETS = 200_000


def _bin(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BIN_BITS)


def with_fingerprint(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """df and out_col: the low-order bits of each bin, an array of BINS integers. text_col has no nulls."""
    words, hashes, least, own, dense = (f"_{out_col}_{x}" for x in ("words", "hashes", "least", "bins", "dense"))
    at = lambda i, k: F.get(F.col(words), i + k)
    shingles = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    first_of_bin = F.filter(hashes, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(hashes), i - 1))))

    def borrowed(value: Column, i: Column) -> Column:
        b = i.cast("long")
        tries = [F.get(F.col(dense), F.pmod(F.xxhash64(b, F.lit(t).cast("long")), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS)]
        rest = F.array_min(F.transform(least, lambda x: F.struct(F.xxhash64(b, _bin(x).cast("long")).alias("r"), x.alias("v"))))["v"]
        return F.coalesce(value, *tries, rest)

    df = df.withColumn(words, F.filter(F.split(text_col, SPACES), lambda w: w != ""))
    df = df.withColumn(hashes, F.sort_array(F.when(F.size(words) >= SHINGLE, shingles).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))))
    df = df.withColumn(least, first_of_bin)
    df = df.withColumn(own, F.transform(least, lambda x: _bin(x).cast("long")))
    df = df.withColumn(dense, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(F.col(least), (F.array_position(F.col(own), b.cast("long")) - 1).cast("int"))))
    df = df.withColumn(out_col, F.transform(F.transform(dense, borrowed), lambda v: v.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")))
    return df.drop(words, hashes, least, own, dense)


def packed(bins: Column) -> Column:
    """The low-order bits as hexadecimal digits."""
    digits = LOW_BITS // 4
    return F.lower(F.array_join(F.transform(bins, lambda v: F.substring(F.hex(v + (1 << LOW_BITS)), 2, digits)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints (arrays), without the agreement by chance."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1.0 - chance))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (hexadecimal digits) for each row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_fingerprint(rows, "_text", "_bins").select(id_col, packed(F.col("_bins")).alias("fingerprint"))


def _bucket_of(id_col: Column, hashed: Column, bounds: list, buckets: int, null_buckets: int) -> Column:
    """A number that grows with (id, hash): bounds are quantiles of the ids; between two of them ids count in proportion,
    and rows of an id that several bounds have are dealt by their hash. Null ids have numbers under 0, by hash.
    """
    share = hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    b = F.lit(bounds)
    below, same = F.size(F.filter(b, lambda x: x < id_col)), F.size(F.filter(b, lambda x: x == id_col))
    low, high = F.get(b, below - 1).cast("double"), F.get(b, below).cast("double")
    between = F.coalesce((id_col.cast("double") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    place = F.when(same > 0, below + 1 + (same - 1) * share).otherwise(below + F.least(between, F.lit(1.0)))
    numbered = F.floor(place * F.lit(buckets / (len(bounds) + 1)))
    return F.when(id_col.isNull(), F.floor(share * null_buckets) - null_buckets).otherwise(numbered if bounds else F.lit(0)).cast("long")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside an edited one, whose last third is the start of the next document (descending id, then hash of the text; cyclic), with fingerprints and likenesses.

    Documents are ordered within buckets of neighbouring ids, whose number grows with the text; what a
    bucket's last document needs of the next bucket's first is joined in, so that no task sees the whole
    order, and a task that sees all buckets has a few numbers of each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"))
    found = rows.agg(F.sum(F.octet_length("_text").cast("long")).alias("size"), F.count_if(F.col("_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"), F.percentile_approx("_id", [i / QUANTILES for i in range(1, QUANTILES)], 10 * QUANTILES).alias("bounds")).first()
    size, cores = found["size"] or 0, docs.sparkSession.sparkContext.defaultParallelism
    buckets = int(max(1, min(size // BUCKET_BYTES, 16 * cores), size // LARGE_BUCKET_BYTES))
    null_buckets = -(-buckets * found["nulls"] // max(1, found["n"]))
    rows = rows.withColumn("_bucket", _bucket_of(F.col("_id"), F.col("_hash"), list(found["bounds"] or []) if buckets > 1 else [], buckets, null_buckets))

    # of each bucket its first row, and the length of its last one's text
    key = F.struct(F.col("_id").isNotNull().alias("some"), "_id", "_hash")
    ends = materialized(rows.groupBy("_bucket").agg(F.max(key).alias("top"), F.min_by(F.length("_text"), key).alias("last")))
    around = Window.orderBy(F.desc("_bucket"))
    whole = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.select(F.col("_bucket").alias("_of"), F.floor(F.col("last") / 3).cast("int").alias("_need"), F.coalesce(F.lead("_bucket").over(around), F.first("_bucket").over(whole)).alias("_bucket"))
    tops = after.join(ends.select("_bucket", F.col("top._id").alias("_id"), F.col("top._hash").alias("_hash")), "_bucket")
    tops = F.broadcast(tops) if buckets + null_buckets <= MAX_BROADCAST_BUCKETS else tops
    heads = rows.alias("r").join(tops.alias("t"), (F.col("r._bucket") == F.col("t._bucket")) & F.col("r._id").eqNullSafe(F.col("t._id")) & (F.col("r._hash") == F.col("t._hash")))
    heads = heads.groupBy("_of", "_need").agg(F.min("_text").alias("_head"))
    heads = with_fingerprint(heads, "_head", "_next_bins").select(F.col("_of").alias("_bucket"), F.substring(F.col("_head"), F.lit(1), F.col("_need")).alias("_head_next"), F.col("_next_bins").alias("_head_bins_next"))
    follow = materialized(heads)

    order = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last("_id"), F.desc("_hash"))
    placed = rows.select("_bucket", "_id", "_text", F.row_number().over(order).alias("_rank"), F.lead("_text").over(order).alias("_lead")).join(follow, "_bucket")
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - third), F.substring(F.coalesce("_lead", "_head_next"), F.lit(1), third))
    made = placed.select("_bucket", "_rank", F.col("_id"), "_text", n.cast("long").alias("n_chars"), edited.alias("_edited"), "_head_bins_next")
    made = with_fingerprint(made.withColumn("edited_sha256", F.sha2("_edited", 256)), "_text", "_bins").drop("_text")
    made = with_fingerprint(made, "_edited", "_edited_bins").drop("_edited")
    ranked = Window.partitionBy("_bucket").orderBy("_rank")
    made = made.withColumn("_next_bins", F.coalesce(F.lead("_bins").over(ranked), F.col("_head_bins_next")))
    return made.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", packed(F.col("_bins")).alias("fingerprint"), packed(F.col("_edited_bins")).alias("edited_fingerprint"), likeness(F.col("_bins"), F.col("_edited_bins")).alias("near_edited"), likeness(F.col("_bins"), F.col("_next_bins")).alias("near_next")
    )
