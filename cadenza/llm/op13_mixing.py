"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Of all rates between 0 and MOST_COPIES
whose tokens meet their source's target, those nearest to one copy each (in Kullback-Leibler divergence)
are min(MOST_COPIES, exp(tilt * size)), with one tilt for each source. Tilts solve the convex dual, by
Newton steps on the logarithm of the tokens, kept within a bracket that every step narrows. All
sources take a step together: a step is one aggregate over counts by (source, size), which are far fewer
than documents. Sums are exact decimals, so that reruns take the very same steps.

Rates are rounded to whole copies: every document has its rate's whole part; for the rest, documents of a
source are in a random order by a hash of their ids, in which those with a larger fraction come sooner
(sequential Poisson sampling), and take one more copy each until the target is met. The last of them takes
the first words of a copy only: a source's taken words are its target, rounded. The place where the
target is met is found by buckets of that order, of about BUCKET documents; only one bucket of a source is
then looked at in order.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, the last;
repeated rows are documents of their own, any of them may take what is cut; an empty table gives no rows.
Ids pass through untouched, whatever their types.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.store import discard, materialized

MOST_COPIES = 2
#: Weights by a source's place in the order of sources, repeating.
WEIGHTS = (3, 1, 2)
#: Tokens of the mix, in percent of all.
PERCENT = 150
#: Documents of a bucket, of whose order one window is computed.
BUCKET = 2000
#: A tilt is found when a source's expected tokens differ from its target by at most this share.
TOLERANCE, STEPS = 1e-9, 80
WORDS = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,9)"


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """kept (a struct of the id), source and size (words)."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    return docs.select(F.struct(docs[f"`{id_col}`"]).alias("kept"), docs[f"`{source_col}`"].cast("string").alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with place, from 0: by code points, null last. A range shuffle's parts are counted, the counts summed up."""
    dealt = materialized(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    carry = F.broadcast(counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("within", within).join(carry, "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "within", "before")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, source_size) with target: shares of percent of all sizes by weight, at most ``most`` times a source's size; what is above goes to the others by weight.

    The level up to which weights are served is a fraction of whole numbers; it rises until no more source
    is above. A round is one sum over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialized(ranked(sources).withColumn("weight", weight.cast("long")))
    wide = lambda c: c.cast("decimal(38,0)")
    numerator, denominator, capped = 0, 1, -1
    while True:  # target = weight * numerator / (100 * denominator), where that is not above the limit
        above = wide(F.col("source_size")) * (100 * most) * F.lit(denominator).cast("decimal(20,0)") <= wide(F.col("weight")) * F.lit(numerator).cast("decimal(28,0)")
        above = above if capped >= 0 else F.lit(False)
        r = table.agg(F.sum(wide(F.col("source_size"))).alias("all"), F.sum(F.when(above, wide(F.col("source_size")))).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"), F.sum(above.cast("long")).alias("n")).first()
        if r["all"] is None or not r["weights"] or r["n"] == capped:
            break
        numerator, denominator, capped = int(r["all"]) * percent - 100 * most * int(r["full"] or 0), int(r["weights"]), r["n"]
    limit = (F.col("source_size") * most).cast("double")
    share = F.col("weight") * F.lit(float(numerator)) / F.lit(float(100 * denominator))
    return table.withColumn("target", F.when(above, limit).otherwise(F.least(share, limit))).withColumn("full", above).select("source", "source_size", "target", "full")


def _rate(tilt: Column, size: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(tilt * size))


def tilts(histogram: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target, full, tilt. histogram: source, size, n (documents).

    A bracket needs no search: at log(most) every document that has words is at its limit, at
    -log(size / target) none has more than its share.
    """
    ratio = F.greatest(F.try_divide("source_size", "target"), F.lit(1.0))
    state = targets.select("source", "source_size", "target", "full", (-F.log(ratio)).alias("low"), F.lit(math.log(most)).alias("high"))
    state = state.withColumn("tilt", F.lit(0.0)).withColumn("open", ~F.col("full") & (F.col("source_size") > 0) & (F.col("target") > 0))
    state = materialized(state)
    for _ in range(STEPS):
        running = state.where("open")
        rate = _rate(F.col("tilt"), F.col("size"), most)
        free = F.exp(F.col("tilt") * F.col("size")) < most
        mass = (F.col("n") * F.col("size")).cast("double")
        met = histogram.join(running.select(F.col("source").alias("_source"), "tilt"), F.col("source").eqNullSafe(F.col("_source")))
        sums = met.groupBy("_source").agg(F.sum((mass * rate).cast(EXACT)).alias("tokens"), F.sum(F.when(free, mass * F.col("size") * rate).otherwise(0.0).cast(EXACT)).alias("slope"))
        sums = sums.select("_source", F.col("tokens").cast("double").alias("tokens"), F.col("slope").cast("double").alias("slope"))
        near = F.abs(F.col("tokens") - F.col("target")) <= TOLERANCE * F.col("target")
        low = F.when(F.col("tokens") < F.col("target"), F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(F.col("tokens") > F.col("target"), F.least("high", "tilt")).otherwise(F.col("high"))
        # the dual's gradient is tokens - target, its second derivative slope; the step is that of log(tokens)
        newton = F.col("tilt") - F.log(F.try_divide("tokens", "target")) * F.col("tokens") / F.when(F.col("slope") > 0, F.col("slope"))
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_low", low).withColumn("_high", high).withColumn("_next", newton)
        middle = (F.col("_low") + F.col("_high")) / 2
        inside = (F.col("_next") > F.col("_low")) & (F.col("_next") < F.col("_high"))
        step = F.when(inside, F.col("_next")).otherwise(middle)
        stay = ~F.col("open") | F.coalesce(near, F.lit(False)) | (F.col("_high") <= F.col("_low"))
        after = moved.select("source", "source_size", "target", "full", F.when(stay, F.col("low")).otherwise(F.col("_low")).alias("low"), F.when(stay, F.col("high")).otherwise(F.col("_high")).alias("high"), F.when(stay, F.col("tilt")).otherwise(step).alias("tilt"), (F.col("open") & ~stay).alias("open"))
        older, state = state, materialized(after)
        discard(older)
        if state.where("open").isEmpty():
            break
    return state.select("source", "source_size", "target", "full", "tilt")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """id, size, source_size, target (of its source), taken (words that the mix takes), rate, copies (whole ones) of each document."""
    if percent > 100 * most:
        raise ValueError(f"{percent} % can't be reached with at most {most} copies")
    sized = materialized(sizes_of(docs, id_col, text_col, source_col))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    histogram = materialized(sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = tilts(histogram, materialized(with_targets(sources, weights, percent, most)), most)
    found = solved.withColumnRenamed("source", "_source")

    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), float(most)).otherwise(_rate(F.col("tilt"), F.col("size"), most))
    rated = sized.join(found, sized["source"].eqNullSafe(found["_source"])).withColumn("rate", rate)
    rated = rated.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.floor("rate"))
    # from 0 to 1: a random number u over the fraction, u / (u + fraction); documents whose rate is whole take no part
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "kept", "size", "source"), 11) + F.lit(0.5)) / float(1 << 53)
    rated = rated.withColumn("draw", F.when(F.col("part") > 0, u / (u + F.col("part"))))
    rated = materialized(rated.select("kept", "source", "size", "source_size", "target", "rate", "whole", "draw"))

    # budget: what a source still takes beyond whole parts; buckets: a source's documents by their draws
    per = rated.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("held"), F.count("draw").alias("drawn"))
    budgets = materialized(per.select(F.col("source").alias("_source"), F.greatest(F.floor(F.col("target") + 0.5).cast("long") - F.col("held"), F.lit(0)).alias("budget"), F.ceil(F.col("drawn") / BUCKET).cast("long").alias("buckets")))
    placed = rated.join(budgets, rated["source"].eqNullSafe(budgets["_source"])).withColumn("bucket", F.floor(F.col("draw") * F.col("buckets")).cast("long"))
    filled = placed.where("draw is not null").groupBy("_source", "budget", "bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = filled.withColumn("held", F.coalesce(F.sum("n").over(w), F.lit(0))).where((F.col("held") < F.col("budget")) & (F.col("held") + F.col("n") >= F.col("budget")))
    edges = materialized(edges.select("_source", F.col("bucket").alias("edge"), (F.col("budget") - F.col("held")).alias("left")))
    edges = edges.withColumnRenamed("_source", "_edge_source")
    known = placed.join(edges, placed["source"].eqNullSafe(edges["_edge_source"]), "left")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    # a source whose budget no bucket meets takes one more copy of all that draw
    clear = known.where(~at_edge).withColumn("more", F.when(F.col("draw").isNotNull() & (F.col("budget") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))), F.col("size")).otherwise(0))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("draw", "kept").rowsBetween(Window.unboundedPreceding, 0))
    edge = known.where(at_edge).withColumn("_upto", upto - F.col("size")).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("_upto"))))
    names = ["kept.*", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"), "rate"]
    out = clear.select(*names).unionByName(edge.select(*names))
    return out.withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long"))
