"""As-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, on keys of which null equals null; the keys are left's."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """left with the right side's latest value at or before its time, by one window over both: no row is multiplied."""
    both = left.withColumn("_time", F.col(left_time)).withColumn("_side", F.lit(1)).unionByName(right.select(*keys, F.col(right_time).alias("_time"), F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_time", "_side")
    return both.withColumn(out, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_time", "_side", "_value")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """points with inside: whether an interval [start, end) of the same key holds them; intervals may overlap.

    One window over both: a point is inside if the furthest end of the intervals that have begun lies
    beyond it. No row is multiplied, and neither side is read twice.
    """
    begun = intervals.where(F.col(start) < F.col(end)).select(*keys, F.col(start).cast("double").alias("_time"), F.col(end).cast("double").alias("_end"), F.lit(0).alias("_side"))
    both = points.withColumn("_time", F.col(at).cast("double")).withColumn("_side", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    reach = F.max("_end").over(Window.partitionBy(*keys).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("inside", F.coalesce(reach > F.col("_time"), F.lit(False))).where("_side = 1").drop("_time", "_side", "_end")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """keys, left's and right's other columns (which must differ in name): a row for each pair of one key whose intervals [start, end) overlap.

    An interval's class is the power of two that its length doesn't exceed. A pair meets in buckets as wide
    as the larger class of the two: there the longer one lies in two buckets at most, and so does the
    shorter one. Intervals are copied twice for each class of the other side that is at least their own, and
    nothing grows with one side times the other, whatever the mixture of lengths. Of the buckets that a pair
    shares, the first owns it. Null keys meet; intervals without a bound, or with an end not after their start,
    overlap nothing.
    """
    both = []
    for df, (start, end), own in ((left, left_bounds, "_l"), (right, right_bounds, "_r")):
        timed = df.where((F.col(start) < F.col(end)) & ~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(end).cast("double")))
        a, b = F.col(start).cast("double"), F.col(end).cast("double")
        both.append(timed.select("*", a.alias(f"{own}a"), b.alias(f"{own}b"), F.ceil(F.log2(b - a)).cast("int").alias(f"{own}c")))
    one, two = both
    classes = [sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((one, "_lc"), (two, "_rc"))]  # one for each power of two: few

    def dealt(df: DataFrame, own: str, level: Column, out: str) -> DataFrame:
        """df with the buckets of each level that it touches."""
        width = F.pow(F.lit(2.0), F.col(f"{own}level"))
        first, last = F.floor(F.col(f"{own}a") / width), F.ceil(F.col(f"{own}b") / width) - 1
        return df.withColumn(f"{own}level", F.explode(level)).withColumn(f"{own}first", first).withColumn(out, F.explode(F.sequence(first, F.greatest(first, last))))

    def levels(known: list[int], own: str, least: int) -> Column:
        """The other side's classes from least above this one's own."""
        return F.filter(F.lit(known).cast("array<int>") if known else F.array().cast("array<int>"), lambda c: c >= F.col(f"{own}c") + least)

    alone = lambda own: F.array(F.col(f"{own}c"))
    pairs = []
    # the left one's class is the larger or the same; then the right one's is larger
    for on_left, on_right in ((alone("_l"), levels(classes[0], "_r", 0)), (levels(classes[1], "_l", 1), alone("_r"))):
        l, r = dealt(one, "_l", on_left, "_lbucket"), dealt(two, "_r", on_right, "_rbucket")
        named = r.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in r.columns if c not in keys])
        met = l.join(named, [*[l[k].eqNullSafe(named[f"_right_{k}"]) for k in keys], l["_llevel"] == named["_rlevel"], l["_lbucket"] == named["_rbucket"]])
        met = met.where((F.col("_la") < F.col("_rb")) & (F.col("_ra") < F.col("_lb")) & (F.col("_lbucket") == F.greatest("_lfirst", "_rfirst")))
        pairs.append(met.select(*left.columns, *[c for c in right.columns if c not in keys]))
    return pairs[0].unionByName(pairs[1])
