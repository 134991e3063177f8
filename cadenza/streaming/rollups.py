"""Aggregates over time that are the same for tables and streams: rollups by window, turns by session window, totals.

On a stream they are watermarked: state of a window goes when the watermark has passed it, rows that come
later than ``delay`` change nothing, and a row that comes twice within the delay counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, ts: str, ids: list[str], delay: str) -> DataFrame:
    """rows without repeats of ids; a stream is watermarked by ts, and forgets ids that the watermark has passed. Rows without a time are left out."""
    timed = rows.where(F.col(ts).isNotNull())
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids) if rows.isStreaming else timed.dropDuplicates(ids)


def measures(value: str) -> dict[str, Column]:
    """What rollups tell of a value: partial sums only, so that a window's state is a few numbers."""
    return {"n": F.count(F.lit(1)), "total": F.sum(value), "lowest": F.min(value), "highest": F.max(value)}


def per_window(rows: DataFrame, keys: list[str], ts: str, aggs: dict[str, Column], width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """keys, start, end and aggs of each window of a fixed width that has rows. A stream can be written in append or update mode."""
    timed = rows.withWatermark(ts, delay) if rows.isStreaming else rows.where(F.col(ts).isNotNull())
    found = timed.groupBy(*keys, F.window(ts, width).alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggs)


def turns_in_time(rows: DataFrame, keys: list[str], ts: str, ids: list[str], aggs: dict[str, Column], gap: str = "320 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """keys, start, end (of the last row, without the gap) and aggs of each turn: rows of a key no further than ``gap`` apart. A stream is written in append mode: a turn comes when it has ended."""
    found = once(rows, ts, ids, delay).groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(F.max(ts).alias("_last"), *[c.alias(n) for n, c in aggs.items()])
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_last").alias("end"), *aggs)


def once_per_window(rows: DataFrame, keys: list[str], ts: str, ids: list[str], aggs: dict[str, Column], width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """As per_window, where a row that comes twice counts once. A stream is written in append mode."""
    found = once(rows, ts, ids, delay).groupBy(*keys, F.window(ts, width).alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggs)
