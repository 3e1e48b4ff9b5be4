"""Packages as a stream: every operator keeps no state between packages, so all of the API takes streams as it takes tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def packages(spark: SparkSession, folder: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files below a folder as packages, each once."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select("path", "length", "content")


def land(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Extracts packages as they arrive and appends the rows to Parquet files, exactly once."""
    writer = extract(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
