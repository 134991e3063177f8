"""Smoothed histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothed(df: DataFrame, keys: list[str], value: Column, bins: int, low: float, high: float, sigma: float) -> DataFrame:
    """keys, bin (from 1), share: counts of values in [low, high] (the last bin is closed) under a Gaussian of 6 sigma + 1 taps, of Euclidean length 1.

    Bins that no value reaches are left out; values elsewhere don't count. Counts are summed before they are spread.
    """
    reach = int(3 * sigma)
    taps = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    place = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins).cast("int")), F.lit(bins).cast("long"))
    counts = df.where((value >= low) & (value <= high)).groupBy(*keys, place.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.array(*[F.struct((F.col("_bin") + d).alias("bin"), (F.col("_n") * (taps[d + reach] / sum(taps))).alias("part")) for d in range(-reach, reach + 1)])
    spread = counts.select(*keys, F.explode(parts).alias("_p")).select(*keys, "_p.bin", "_p.part").where(F.col("bin").between(1, bins))
    smooth = spread.groupBy(*keys, "bin").agg(F.sum("part").alias("_x"))
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(*keys)))
    return smooth.select(*keys, "bin", F.when(length > 1e-8, F.col("_x") / length).otherwise(F.col("_x")).alias("share"))
