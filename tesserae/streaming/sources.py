"""Streams of text and of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def token_stream(spark: SparkSession, folder: str, separator: str = "\n", files_per_trigger: int = 16) -> DataFrame:
    """Tokens of text files as they arrive; few files a trigger hold back a fast writer."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("lineSep", separator).text(folder)
    return lines.select(F.regexp_replace("value", "\r$", "").alias("token")).where("token <> ''")


def watched_images(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Image files as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path", "content")


def write_text(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return lines.writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)
