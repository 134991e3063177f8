"""Rolling statistics over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_back(keys: list[str], order: list[str], n: int):
    """This row and the n - 1 before it."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)


def cv_gate(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 40, least: int = 12, low: float = 0.15, high: float = 2.5) -> DataFrame:
    """cv (population deviation over mean of the last rows) and passed: true while there are few rows, else low <= cv <= high."""
    w = rows_back(keys, order, width)
    cv = F.stddev_pop(value).over(w) / (F.avg(value).over(w) + F.lit(1e-10))
    return df.withColumn("cv", cv).withColumn("passed", F.when(F.count(value).over(w) < least, True).otherwise(F.col("cv").between(low, high)))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 5, out: str = "smooth") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(rows_back(keys, order, width)))


def centred_smooth(df: DataFrame, keys: list[str], order: list[str], value: str, half: int = 2, out: str = "smooth") -> DataFrame:
    """Zero-padded centred mean, as a convolution of the same length gives; unchanged where a key has few rows."""
    w = Window.partitionBy(*keys)
    around = w.orderBy(*order).rowsBetween(-half, half)
    return df.withColumn(out, F.when(F.count("*").over(w) > 2 * half + 1, F.sum(value).over(around) / (2 * half + 1)).otherwise(F.col(value)))


def percentile_threshold(df: DataFrame, keys: list[str], value: str, p: float, floor: float, minimum: float, least: int, out: str = "gate", default: float | None = None) -> DataFrame:
    """The p-th percentile (linear interpolation) of the values above floor, if there are enough, else the default (minimum if there is none); at least minimum."""
    w = Window.partitionBy(*keys)
    above = F.when(F.col(value) > floor, F.col(value))
    found = F.when(F.count(above).over(w) >= least, F.percentile(above, p).over(w))
    return df.withColumn(out, F.greatest(F.coalesce(found, F.lit(minimum if default is None else default)), F.lit(minimum)))


def voiced_groups(df: DataFrame, keys: list[str], order: list[str], voiced: Column, size: int = 63) -> DataFrame:
    """Voiced rows with the number of the full group of ``size`` voiced rows that each completes part of."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.where(voiced).withColumn("group", F.floor((F.row_number().over(w) - 1) / size).cast("long")).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "group"))).where(F.col("_n") == size).drop("_n")
