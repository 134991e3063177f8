"""Voices from audio by a model that the caller brings.

``load`` makes the model: a function of samples (float32, mono, RATE) that gives a vector, or None where it finds
no voice. It is called once in each task, not for each batch. Least lengths hold before and, by the model's
own trimming if it has one (``prepare``), after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cadenza.operators import joins, vectors
from cadenza.operators.tables import written
from cadenza.sources import wav
from cadenza.sources.wav import RATE

#: Seconds of an enrolment chunk; the least that is embedded.
CHUNK, LEAST = 3.0, 0.5

Model = Callable[[np.ndarray], "np.ndarray | None"]


def embedding(samples: Column, load: Callable[[], Model], prepare: Callable[[np.ndarray], np.ndarray] | None = None, least: float = LEAST) -> Column:
    """The unit vector of each row's samples; null where they are shorter than ``least`` seconds, before or after prepare, or the model fails or finds no voice."""

    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([_unit(one(model, x)) for x in batch], dtype=object)

    def one(model: Model, x: np.ndarray | None) -> np.ndarray | None:
        if x is None or len(x) < least * RATE:
            return None
        try:
            x = np.asarray(x, np.float32)
            x = x if prepare is None else prepare(x)
            return None if len(x) < least * RATE else model(x)
        except Exception:  # a chunk that the model can't take has no vector
            return None

    def _unit(v: np.ndarray | None) -> list[float] | None:
        if v is None or not np.isfinite(v).all():
            return None
        v = np.asarray(v, float)
        n = np.linalg.norm(v)
        return (v / n if n > 1e-8 else v).tolist()

    return run(samples)


def embedded_chunks(recordings: DataFrame, load: Callable[[], Model], prepare: Callable[[np.ndarray], np.ndarray] | None = None, seconds: float = CHUNK) -> DataFrame:
    """recording_id, chunk, vector of each whole chunk that has one; where none has, of the whole recording (chunk -1). Vectors are made once and written."""
    made = wav.chunks_of(recordings, seconds).select("recording_id", "chunk", "samples").withColumn("vector", embedding(F.col("samples"), load, prepare))
    made = written(made.select("recording_id", F.col("chunk").cast("int").alias("chunk"), "vector")).where("vector is not null")
    rest = recordings.join(made.select("recording_id").distinct(), "recording_id", "left_anti").select("recording_id", F.lit(-1).alias("chunk"), embedding(F.col("samples"), load, prepare).alias("vector"))
    return made.unionByName(written(rest).where("vector is not null"))


def enrolled(recordings: DataFrame, load: Callable[[], Model], prepare: Callable[[np.ndarray], np.ndarray] | None = None, key: str = "recording_id") -> DataFrame:
    """key, n, centroid: the mean of the unit vectors of each key's chunks, of length 1. recordings: recording_id, samples and key (a person may have several recordings).

    A key without any vector fails the job: nobody can be enrolled from its audio.
    """
    chunks = embedded_chunks(recordings, load, prepare)
    owned = chunks if key == "recording_id" else chunks.join(recordings.select("recording_id", key), "recording_id")
    counted = owned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    mean = vectors.centroids(owned, [key], "vector", "mean")
    every = joins.null_safe(recordings.select(key).distinct(), joins.null_safe(counted, mean, [key]), [key], "left")
    failed = F.raise_error(F.concat(F.lit("no voice in the audio of "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f": at least {LEAST} s of speech are needed")))
    return every.select(key, "n", F.when(F.col("mean").isNull(), failed).otherwise(vectors.unit(F.col("mean"))).alias("centroid"))
