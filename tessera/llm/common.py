"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import discarded, file_system, shared_dir, written

__all__ = ["ROWS_PER_BATCH", "bounded_batches", "discarded", "file_system", "plain_text", "shared_dir", "table", "written"]

# Arrow batches hold whole documents; a batch of this many rows stays small even
# when a run of very long documents meets in one batch.
ROWS_PER_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables by a path that Spark's readers resolve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hold the Arrow batch at ROWS_PER_BATCH rows for the Python stages of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def plain_text(column: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
