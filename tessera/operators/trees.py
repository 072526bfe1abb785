"""Minimum spanning trees of images: neighbouring pixels by colour distance, taken in Borůvka's rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.colour import edge_weight
from tessera.operators.graphs import OF, spanning_forest
from tessera.operators.regions import RGB, neighbours
from tessera.operators.runs import pixel_name


def pixel_links(pixels: DataFrame) -> DataFrame:
    """links(image_id, a, b, weight, ident) between neighbouring pixels: the largest channel distance, then the first pixel, right before down."""
    named = pixels.select(OF, "x", "y", *RGB, pixel_name().alias("node"))
    pairs = neighbours(named, [*RGB, "node", "y"])
    weight = edge_weight([F.col(c) for c in RGB], [F.col(f"n_{c}") for c in RGB])
    return pairs.select(OF, F.col("node").alias("a"), F.col("n_node").alias("b"), weight.alias("weight"), (F.col("node") * 2 + (F.col("n_y") != F.col("y")).cast("int")).alias("ident"))


def tree_links(pixels: DataFrame) -> DataFrame:
    """The links (image_id, a, b, weight, ident) of each image's minimum spanning tree."""
    return spanning_forest(pixel_links(pixels))
