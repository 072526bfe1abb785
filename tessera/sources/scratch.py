"""Tables in the folder that driver and executors share: where iterations put what they have so far."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset on a single machine (tests) a
    local folder takes its place; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    own = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system that ``path`` stands in, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    A later stage that loses an executor rereads the files instead of
    recomputing everything above.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dealt(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for rows whose number follows the pixels: joins with them shuffle.

    By its files, which hold runs of equal numbers in few bytes, such a table
    seems small enough for a broadcast, and the driver would hold it unfolded.
    """
    table = written(df, name)
    out = table.hint("merge")
    out.written_path = table.written_path
    return out


def written_counting(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """As ``dealt``, with the number of rows that meet ``condition``, counted while they are written."""
    seen = Observation()
    out = dealt(df.observe(seen, F.count_if(condition).alias("n")), name)
    return out, seen.get["n"]


def discarded(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    for table_ in tables:
        fs, at = file_system(table_.sparkSession, table_.written_path)
        fs.delete(at, True)
