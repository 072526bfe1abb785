"""Raster tables: pixels(image_id, x, y, r, g, b, a), one row for each pixel.

``image_id`` is the partition key everywhere; images are bounded, tables of
images are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64
#: Images to a task, about; fewer as long as there are more cores than tasks.
IMAGES_PER_TASK = 16


def level(e: Column) -> Column:
    """A component of a unit vector as a grey level."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.6) * 212.5).cast("int")))


def rotated(values: Column, by: int) -> Column:
    return F.concat(F.slice(values, by + 1, SIDE - by), F.slice(values, 1, by))


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64 embeddings are an image: a row for each vector, channels a third of a turn apart; dark reds are transparent.

    Rows are brought together by image before they are exploded, so that every
    later window or group over an image needs no shuffle of pixels.  The number
    of tasks follows the number of images: left to itself Spark would choose it by
    the bytes of the vectors, which become a hundred times as many as pixels.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr("vec_id div 64").alias("image_id"), "vec_id", "embedding")
    images = -(-vectors.count() // SIDE)
    tasks = max(1, images // IMAGES_PER_TASK, min(images, spark.sparkContext.defaultParallelism))
    rows = vectors.repartition(tasks, "image_id")
    rows = rows.select("image_id", (F.col("vec_id") % 64).cast("int").alias("y"), F.transform("embedding", level).alias("v"))
    zipped = F.arrays_zip(F.col("v").alias("r"), rotated(F.col("v"), 21).alias("g"), rotated(F.col("v"), 42).alias("b"))
    flat = rows.select("image_id", "y", F.posexplode(zipped).alias("x", "c"))
    return flat.select("image_id", "x", "y", "c.r", "c.g", "c.b", F.when(F.col("c.r") < 48, 0).otherwise(255).alias("a"))


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64 users are an image: hours across, users down, levels by how often; cells without events are left out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = events.groupBy("user_id", F.hour("ts").alias("x")).agg(F.count("*").alias("n"))
    v = F.least(F.lit(255), 16 * F.col("n")).cast("int")
    return cells.select(F.expr("user_id div 64").alias("image_id"), "x", (F.col("user_id") % 64).cast("int").alias("y"), v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"))


def image_rows(pixels: DataFrame) -> DataFrame:
    """images(image_id, width, height, rgba): pixels packed row by row; cells without a pixel are transparent black.

    Packing happens by arrays of one row each, so that no group is larger than an image.
    """
    one = F.concat(*[F.unhex(F.lpad(F.hex(c), 2, "0")) for c in "rgba"])
    cells = pixels.withColumn("px", one)
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    lines = cells.groupBy("image_id", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "px"))).alias("m"))
    blank = F.unhex(F.lit("00000000"))
    packed = lines.join(size, "image_id").select("image_id", "width", "height", "y", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.coalesce(F.col("m")[x], blank)).alias("row"))
    whole = packed.groupBy("image_id", "width", "height").agg(F.map_from_entries(F.collect_list(F.struct("y", "row"))).alias("rows"))
    empty = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: blank)
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.coalesce(F.col("rows")[y], empty)))
    return whole.select("image_id", "width", "height", F.unhex(F.array_join(F.transform(flat, F.hex), "")).alias("rgba"))


def exploded(images: DataFrame) -> DataFrame:
    """The pixels of images(image_id, width, height, rgba)."""
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i")
    rows = images.filter("width > 0 and height > 0").select("image_id", "width", F.hex("rgba").alias("h"), at)

    def channel(k: int) -> Column:
        return F.conv(F.substring(F.col("h"), F.col("i") * 8 + 2 * k + 1, 2), 16, 10).cast("int")

    return rows.select("image_id", (F.col("i") % F.col("width")).cast("int").alias("x"), F.expr("i div width").cast("int").alias("y"), *[channel(k).alias(c) for k, c in enumerate("rgba")])


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """images(image_id, width, height, rgba, error) of the files under ``path`` that the platform's codec reads.

    The image source delivers rows of BGR or BGRA; what it cannot read has a message and no pixels.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    step = F.col("nChannels")
    h = F.hex("data")
    at = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)

    def byte(i: Column, k: Column | int) -> Column:
        return F.substring(h, (i * step + k) * 2 + 1, F.lit(2))

    grey = F.transform(at, lambda i: F.concat(byte(i, 0), byte(i, 0), byte(i, 0), F.lit("FF")))
    colour = F.transform(at, lambda i: F.concat(byte(i, 2), byte(i, 1), byte(i, 0), F.when(step == 4, byte(i, 3)).otherwise("FF")))
    good = (F.col("width") > 0) & (F.col("height") > 0)
    rgba = F.when(good, F.unhex(F.array_join(F.when(step == 1, grey).otherwise(colour), "")))
    return raw.select(F.col("origin").alias("image_id"), "width", "height", rgba.alias("rgba"), F.when(~good, "not a readable image").alias("error"))
