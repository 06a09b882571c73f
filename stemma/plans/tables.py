"""Lineage is cut on the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def share(spark: SparkSession) -> None:
    """Name the folder for checkpoints: that of spark.checkpoint.dir; where it is unset, a temporary one of a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(found or tempfile.mkdtemp(prefix="stemma-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on: rounds of a loop don't repeat earlier ones."""
    share(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the application's part of the shared folder and read from there: plans over it are small,
    they read only the columns that they use, and its size is known."""
    spark = df.sparkSession
    share(spark)
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    path = f"{folder}/stemma-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
