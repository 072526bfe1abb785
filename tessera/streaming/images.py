"""Images and requests that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.functions.text import image_format

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path, modificationTime, length, content, format) of the files put under ``path``."""
    return spark.readStream.format("binaryFile").schema(FILES).load(path).withColumn("format", image_format(F.col("content")))


def newest_requests(requests: DataFrame) -> DataFrame:
    """Of requests(image_id, generation, settings), stream or table, the newest for each image; earlier ones are superseded.

    The state is one row for each image.
    """
    return requests.groupBy("image_id").agg(F.max("generation").alias("generation"), F.max_by("settings", "generation").alias("settings"), (F.count("*") - 1).alias("superseded"))


def svg_writer(svgs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends (image_id, svg) of a stream as Parquet, each batch once."""
    return svgs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
