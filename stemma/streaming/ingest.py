"""Documents that arrive in a folder, unit by unit, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import markup


def arriving(spark: SparkSession, folder: str, pattern: str = "*", at_once: int = 100) -> DataFrame:
    """file, text of each file as it arrives, at most `at_once` files in a batch. M07."""
    found = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", at_once).option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def unit_stream(files: DataFrame, kind: str) -> DataFrame:
    """The units of arriving files (file, text), each file parsed once, by one task. M07."""
    return markup.units(files, kind, "file", "text")
