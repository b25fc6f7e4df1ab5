"""Cutting the lineage of iterative operators with tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, read from the session. A folder
    of our own is set only where the session has none and is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def own_dir(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{shared_dir(spark)}/quillgraph/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows as a Parquet table in the shared folder: a lost executor costs the tasks
    that ran on it, never what was written, and later plans still prune columns, push
    filters down and know sizes."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> bool:
    """Remove the tables that this application has cut to; call it when no result that
    reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
