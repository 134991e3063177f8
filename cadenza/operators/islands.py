"""Ordered-run operators: hysteresis, islands, interval merging. All are windows over (keys, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def hysteresis(df: DataFrame, keys: list[str], order: list[str], flag: Column, onset: int = 3, offset: int = 10, out: str = "active") -> DataFrame:
    """Turns on at the onset-th flagged row in a row, off at the offset-th unflagged one, else stays; starts off."""
    w = _order(keys, order)
    runs = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_turn", F.coalesce((F.col("_flag") != F.lag("_flag").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_turn").over(w)).withColumn("_pos", F.row_number().over(_order([*keys, "_run"], order)))
    decided = F.when(F.col("_flag") & (F.col("_pos") >= onset), True).when(~F.col("_flag") & (F.col("_pos") >= offset), False)
    return runs.withColumn(out, F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(False))).drop("_flag", "_turn", "_run", "_pos")


def islands(df: DataFrame, keys: list[str], index: str, member: Column, gap: int = 1, out: str = "island") -> DataFrame:
    """Members only, numbered by island: a new one starts where the index grew by more than gap."""
    w = _order(keys, [index])
    kept = df.where(member).withColumn("_new", F.coalesce((F.col(index) - F.lag(index).over(w) > gap).cast("int"), F.lit(1)))
    return kept.withColumn(out, F.sum("_new").over(w)).drop("_new")


def energy_segments(df: DataFrame, keys: list[str], index: str, voiced: Column, silence: int = 6, least: int = 10) -> DataFrame:
    """keys, segment, start_frame, end_frame (exclusive): voiced islands closed by ``silence`` silent frames.

    The last island reaches the end if fewer silent frames follow it; islands shorter than ``least`` frames go, the others are renumbered from 0.
    """
    w = Window.partitionBy(*keys)
    sized = df.withColumn("_n", F.max(index).over(w) + 1)
    found = islands(sized, keys, index, voiced, silence).groupBy(*keys, "island").agg(F.min(index).alias("start_frame"), (F.max(index) + 1).alias("_end"), F.max("_n").alias("_n"))
    end = F.when(F.col("_n") - F.col("_end") < silence, F.col("_n")).otherwise(F.col("_end"))
    kept = found.withColumn("end_frame", end).where(F.col("end_frame") - F.col("start_frame") >= least)
    return kept.withColumn("segment", F.row_number().over(_order(keys, ["start_frame"])) - 1).select(*keys, "segment", "start_frame", "end_frame")


def state_segments(df: DataFrame, keys: list[str], index: str, active: str, step: float = 1.0) -> DataFrame:
    """keys, start_s, end_s of each stretch of an active state: the end is the start of the next row, or the total length."""
    w = _order(keys, [index])
    ended = df.withColumn("_next", F.coalesce(F.lead(index).over(w), F.col(index) + 1))
    found = islands(ended, keys, index, F.col(active)).groupBy(*keys, "island").agg(F.min(index).alias("_a"), F.max("_next").alias("_b"))
    return found.select(*keys, (F.col("_a") * step).alias("start_s"), (F.col("_b") * step).alias("end_s"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, tolerance: float = 0.0, aggs: dict[str, Column] | None = None, strict: bool = False) -> DataFrame:
    """Intervals joined while the next starts within tolerance of the furthest end so far; aggs are taken over each merged group."""
    w = _order(keys, [start, end])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(start) - reach >= tolerance) if strict else (F.col(start) > reach + tolerance)
    grouped = df.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("_group", F.sum("_new").over(w))
    extra = [c.alias(n) for n, c in (aggs or {}).items()]
    return grouped.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), *extra).drop("_group")


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the row before."""
    before = F.lag(state).over(_order(keys, order))
    return df.withColumn("previous", before).where(F.col("previous") != F.col(state))
