"""Settings chosen for each image by the rules, and documents drawn with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import clusters, decisions, features, mosaic, palettes, paths, pixels
from tessera.sources.scratch import dealt, written

SEGMENT = ["color_precision", "layer_difference", "filter_speckle"]
DRAW = ["fit_mode", "corner_threshold", "segment_length", "splice_threshold", "simplify"]


def tuned(px: DataFrame, goal: str = "balanced", side: int = features.SAMPLES) -> DataFrame:
    """(image_id, parameters...): scans by the line-art profile, other images by their class."""
    found = features.image_features(px, side)
    rules = decisions.heuristic_decision(found).filter(F.col("goal") == goal)
    scans = decisions.scan_direct(found).filter(F.col("goal") == goal)
    scan = scans.select("image_id", F.struct(*decisions.PARAMETERS).alias("scan"))
    own = F.struct(*decisions.PARAMETERS)
    return rules.join(scan, "image_id", "left").select("image_id", F.coalesce("scan", own).alias("p")).select("image_id", "p.*")


def segmented(px: DataFrame, chosen: DataFrame) -> DataFrame:
    """Layers of each image by its own settings: colour clusters, or ink by a fixed or an adaptive threshold, in few colours where it asks for them."""
    colour = clusters.colour_layers(clusters.with_keyed(px).join(chosen.filter("clustering <> 'binary'").select("image_id", *SEGMENT), "image_id"))
    binary = chosen.filter("clustering = 'binary'")
    drawn = px.join(binary.select("image_id", "binary_threshold", "binary_adaptive"), "image_id")
    fixed = drawn.filter("not binary_adaptive").select("image_id", "x", "y", (pixels.grey_level() < F.col("binary_threshold")).cast("int").alias("fg"))
    ink = clusters.binary_layers(fixed.unionByName(pixels.adaptive_threshold(drawn.filter("binary_adaptive"))), 0)
    ink = ink.join(binary.select("image_id", "filter_speckle"), "image_id").filter("size(cells) >= filter_speckle * filter_speckle").drop("filter_speckle")
    # read by every branch below, and kernels over whole images are what costs most
    layers = dealt(colour.unionByName(ink).join(chosen.select("image_id", "max_colors"), "image_id"), "layers")
    few = palettes.joined_neighbours(palettes.quantised_layers(layers.filter("max_colors is not null"), 0))
    return layers.filter("max_colors is null").drop("max_colors").unionByName(few)


def auto_vectorise(px: DataFrame, goal: str = "balanced", level: int = 1, digits: int = 2, side: int = features.SAMPLES) -> DataFrame:
    """(image_id, svg), each image with all of its own settings, stacked or as a flat partition."""
    chosen = written(tuned(px, goal, side), "chosen")  # a row for each image, read by every branch
    layers, sizes = segmented(px, chosen), pixels.sizes(px)
    flat = chosen.filter("hierarchical = 'cutout'")
    stacked = chosen.filter("hierarchical <> 'cutout'")
    labels = mosaic.labels_of_layers(layers.join(flat.select("image_id"), "image_id")).join(flat.select("image_id", "layer_difference"), "image_id")
    faces = mosaic.region_paths(mosaic.merged_similar(labels, 16).join(flat.select("image_id", *DRAW), "image_id"), "spline")
    outlines = paths.contours(layers.join(stacked.select("image_id", *DRAW), "image_id"), "spline")
    return paths.documents_of(outlines, sizes.join(stacked.select("image_id"), "image_id"), level, digits).unionByName(
        paths.documents_of(faces, sizes.join(flat.select("image_id"), "image_id"), level, digits)
    )
