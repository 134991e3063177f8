"""Whole reports as numbered lines of text, by section: what a caller orders by (keys, section, line) and writes.

Numbers are printed with halves going up. Null keys are one key; an empty table gives no lines. Lines are made by
key and by row: a report is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import joins

#: Far less than a printed digit, and more than a double's error: halves are printed alike everywhere.
NUDGE = 1e-9
#: Cells of a bar that shows a share.
CELLS = 20


def text(form: str, *values: Column) -> Column:
    """A line: doubles for %f places, whole numbers for %d ones."""
    return F.format_string(form, *values)


def number(x: Column) -> Column:
    return x.cast("double") + NUDGE


def share(part: Column, whole: Column) -> Column:
    """Percent, of 1 if the whole is less."""
    return 100 * part / F.greatest(whole, F.lit(1.0))


def bar(percent: Column) -> Column:
    """A cell for each whole twentieth."""
    full = F.floor(percent * CELLS / 100 + NUDGE).cast("int")
    return F.rpad(F.repeat(F.lit("#"), full), CELLS, ".")


def _lines(df: DataFrame, keys: list[str], section: int, line: Column, content: Column) -> DataFrame:
    return df.select(*keys, F.lit(section).alias("section"), line.cast("long").alias("line"), content.alias("text"))


def activity_report(frames: DataFrame, segments: DataFrame, keys: list[str], index: str, active: str, level: str, step: float, per: int) -> DataFrame:
    """keys, section, line, text: 1, speech, silence and segments of the whole; 2, each segment (keys, start_s, end_s); 3, the first state and each change of it, with the level; 4, each ``per`` frames, with a bar of the share of active ones."""
    whole = frames.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(step)).alias("_whole"))
    spoken = segments.groupBy(*keys).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_speech"), F.count(F.lit(1)).alias("_n"))
    sums = joins.null_safe(whole, spoken, keys, "left").withColumn("_speech", F.coalesce("_speech", F.lit(0.0))).withColumn("_n", F.coalesce("_n", F.lit(0)))
    timed = lambda name, seconds: text(f"{name} %.2f s (%.1f %%)", number(seconds), number(share(seconds, F.col("_whole"))))
    silent = F.col("_whole") - F.col("_speech")
    head = F.array(text("duration %.2f s", number(F.col("_whole"))), timed("speech", F.col("_speech")), timed("silence", silent), text("segments %d", F.col("_n")))
    first = sums.select(*keys, F.posexplode(head).alias("_i", "_text"))
    ranked = segments.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "end_s")))
    one = text("%4d %9.2f s %9.2f s %9.2f s", F.col("_rank"), number(F.col("start_s")), number(F.col("end_s")), number(F.col("end_s") - F.col("start_s")))
    before = F.lag(active).over(Window.partitionBy(*keys).orderBy(index))
    turned = frames.withColumn("_before", before).where(~F.col(active).eqNullSafe(F.col("_before")))
    change = text("%9.2f s %-7s %9.5f", number(F.col(index) * step), F.when(F.col(active), "SPEECH").otherwise("SILENCE"), number(F.col(level)))
    parts = frames.groupBy(*keys, F.floor(F.col(index) / per).alias("_part")).agg((100.0 * F.count_if(active) / F.count(F.lit(1))).alias("_share"), F.avg(level).alias("_level"))
    shown = F.concat(text("%5d %6.0f %% %9.5f ", F.col("_part"), number(F.col("_share")), number(F.col("_level"))), bar(F.col("_share")))
    made = _lines(first, keys, 1, F.col("_i") + 1, F.col("_text")), _lines(ranked, keys, 2, F.col("_rank"), one), _lines(turned, keys, 3, F.col(index), change), _lines(parts, keys, 4, F.col("_part"), shown)
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def flag_report(flags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, line, text of merged flags (keys, start_s, end_s, scenario, kind, confidence, severity): 1, how many of each severity and scenario, and their seconds; 2, each flag. A key without flags has no lines."""
    of = lambda name, value: F.count_if(F.col(name) == value)
    sums = flags.groupBy(*keys).agg(
        text("flags %d, HIGH %d, MEDIUM %d", F.count(F.lit(1)), of("severity", "HIGH"), of("severity", "MEDIUM")).alias("_a"),
        text("at once %d, changed voice %d, both %d", of("scenario", "A"), of("scenario", "B"), of("scenario", "AB")).alias("_b"),
        text("flagged %.2f s", number(F.sum(F.col("end_s") - F.col("start_s")))).alias("_c"),
    )
    first = sums.select(*keys, F.posexplode(F.array("_a", "_b", "_c")).alias("_i", "_text"))
    ranked = flags.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "end_s")))
    one = text("%4d %-2s %9.2f s %9.2f s %6.3f %-6s %s", F.col("_rank"), F.col("scenario"), number(F.col("start_s")), number(F.col("end_s")), number(F.col("confidence")), F.col("severity"), F.col("kind"))
    return _lines(first, keys, 1, F.col("_i") + 1, F.col("_text")).unionByName(_lines(ranked, keys, 2, F.col("_rank"), one))
