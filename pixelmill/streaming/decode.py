"""Files decoded as they arrive: the same stateless functions on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import images

FILES = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(image_id, path, content) of files that appear under ``path``."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return found.select(F.xxhash64("path").alias("image_id"), "path", "content")


def pixels(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return images.decode(incoming(spark, path).select("image_id", "content"), mode)


def stored(spark: SparkSession, path: str, target: str, checkpoint: str, mode: str = "PERMISSIVE"):
    """A query that writes the pixels of all files seen so far as Parquet and then stops."""
    return pixels(spark, path, mode).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
