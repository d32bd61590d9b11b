"""Tables written to the folder that driver and executors share, for the length of the application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """Under spark.checkpoint.dir; without one, a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomwork-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def until_end(spark: SparkSession, folder: str) -> None:
    """The folder goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    until_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)
