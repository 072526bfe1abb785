"""Palettes and documents as files, and generated scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import hex_channels, palette_tokens


def palette_file(spark: SparkSession, path: str, most: int = 4096) -> tuple[tuple[int, int, int], ...]:
    """The colours of a palette text, in order; a token that is no colour, or more than ``most`` colours, is an error."""
    tokens = spark.read.text(path, wholetext=True).select(F.posexplode(palette_tokens(F.col("value"))).alias("at", "token"))
    rows = tokens.select("at", "token", hex_channels(F.col("token")).alias("c")).orderBy("at").take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} colours")
    for r in rows:
        if r["c"] is None:
            raise ValueError(f"{r['token']!r} is not a #rrggbb colour")
    return tuple(tuple(r["c"]) for r in rows)


def write_documents(svgs: DataFrame, path: str) -> None:
    """(image_id, svg) as text files, a folder for each image."""
    svgs.select("image_id", F.regexp_replace("svg", r"\n$", "").alias("value")).write.partitionBy("image_id").text(path)


def preview_size(width: Column, height: Column, most_width: float, most_height: float) -> Column:
    """struct(width, height) of a picture fitted into a box, its shape kept, one pixel at least."""
    scale = F.least(most_width / width, most_height / height)
    return F.struct(*[F.greatest(F.lit(1), F.floor(v * scale + 0.5).cast("int")).alias(n) for n, v in (("width", width), ("height", height))])


def scene_pixels(spark: SparkSession, images: int, width: int, height: int) -> DataFrame:
    """pixels of generated scenes: a sky that fades, a sun, and a hill; one picture differs from the next by where the sun stands."""
    cells = spark.range(images * width * height)
    i = F.col("id") % (width * height)
    at = cells.select(F.expr(f"id div {width * height}").alias("image_id"), (i % width).cast("int").alias("x"), F.floor(i / width).cast("int").alias("y"))
    sun = (F.pow(F.col("x") - width * (0.2 + 0.6 * (F.col("image_id") % 7) / 7), 2) + F.pow(F.col("y") - height / 4, 2)) < (width / 10) ** 2
    hill = F.col("y") > height * 0.7 + height / 12 * F.sin(F.col("x") * (6.28 / width))
    fade = (F.col("y") * 80 / height).cast("int")
    colours = {"r": (F.lit(40), F.lit(250), 90 + fade), "g": (F.lit(110), F.lit(210), 150 + fade), "b": (F.lit(50), F.lit(60), F.lit(235))}
    return at.select("image_id", "x", "y", *[F.when(hill, h).when(sun, s).otherwise(k).alias(c) for c, (h, s, k) in colours.items()], F.lit(255).alias("a"))
