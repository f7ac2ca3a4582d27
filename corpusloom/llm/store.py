"""Intermediate tables and checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names.

    Where that is unset, a local run gets a fresh temporary folder; on a cluster that is an error, as executors
    could not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/corpusloom/{spark.sparkContext.applicationId}"


def save(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> bool:
    """Remove every intermediate table of this application; call it once results are written.  False: there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
