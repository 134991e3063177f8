"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a fresh temporary one.

    On a cluster it must be set: executors would write to disks of their own. Tables in it that no
    operator discards are the caller's to clear when results have been read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialized(df: DataFrame, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends here. partition_by: a column by whose values files are kept apart."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of materialized tables, or of frames over nothing else, that nothing will read any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f[: f.index("/", f.index("/tables/") + 8)] for f in df.inputFiles() if "/tables/" in f}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
