"""Intermediate tables of operators, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and all runs on one machine (tests), a fresh one in /tmp; elsewhere it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def parts(df: DataFrame) -> int:
    """A number of parts to repartition by: given one, adaptive execution doesn't join small parts, whose bytes tell too little where rows grow later or compress well."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read again: it isn't computed a second time, and lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
