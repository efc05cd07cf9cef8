"""Streaming reads of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.copybook import Item
from recordloom.sources.fixed_width import decode


def scan_stream(spark: SparkSession, folder: str, item: Item, files_a_trigger: int = 100) -> DataFrame:
    """Records of the text files that arrive in a folder, decoded like the batch scan."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder).select(*decode(F.col("value"), item))
