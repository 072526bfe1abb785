"""Fewer colours: a fixed palette, or one found by median cut; equal neighbours in paint order then become one layer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.colour import lab_distance, oklab
from tessera.operators.clusters import setting


def median_cut(samples: list[tuple[tuple[int, int, int], int]], most: int) -> list[tuple[int, int, int]]:
    """Weighted mean colours of at most ``most`` boxes: the widest box is cut where half its weight is reached, along its widest channel."""

    def spans(box: list) -> list[int]:
        return [max(c[k] for c, _ in box) - min(c[k] for c, _ in box) for k in range(3)]

    boxes = [sorted(samples)]
    while len(boxes) < most:
        wide = [max(spans(b)) if len(b) > 1 else -1 for b in boxes]
        if max(wide) < 0:
            break
        box = boxes.pop(wide.index(max(wide)))
        channel = spans(box).index(max(spans(box)))
        box = sorted(box, key=lambda s: (s[0][channel], s))  # noqa: B023
        half, run, cut = sum(n for _, n in box) // 2, 0, 1
        for i, (_, n) in enumerate(box, 1):
            run += n
            if run >= half:
                cut = min(max(i, 1), len(box) - 1)
                break
        boxes += [box[:cut], box[cut:]]
    return [tuple(sum(c[k] * n for c, n in b) // sum(n for _, n in b) for k in range(3)) for b in boxes]  # type: ignore[misc]


def quantised_layers(layers: DataFrame, most: int) -> DataFrame:
    """Layers in at most ``most`` colours of their image's own; a layer weighs its area and one more.

    Images may bring their own max_colors in place of ``most``.  Layers are read
    twice: hand in a table that is written.
    """
    own_most = ["max_colors"] if "max_colors" in layers.columns else []

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = median_cut([((int(r), int(g), int(b)), int(n) + 1) for r, g, b, n in zip(pdf.r, pdf.g, pdf.b, pdf.n)], int(setting(pdf, "max_colors", most)))
        return pd.DataFrame([(key[0], i, *c) for i, c in enumerate(found)], columns=["image_id", "i", "pr", "pg", "pb"])

    slim = layers.select("image_id", "r", "g", "b", F.size("cells").alias("n"), *own_most)
    palettes = slim.groupBy("image_id").applyInPandas(kernel, "image_id long, i int, pr int, pg int, pb int")
    entry = F.struct("i", *[F.col(f"p{c}").alias(c) for c in "rgb"], oklab(F.col("pr"), F.col("pg"), F.col("pb")).alias("lab"))
    held = palettes.groupBy("image_id").agg(F.collect_list(entry).alias("_palette"))  # ``most`` entries
    own = layers.join(held, "image_id").withColumn("_lab", oklab(F.col("r"), F.col("g"), F.col("b")))
    near = F.array_min(F.transform("_palette", lambda p: F.struct(lab_distance(F.col("_lab"), p["lab"]).alias("d"), p["i"].alias("i"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"))))
    return own.withColumn("_near", near).select("image_id", "z", *[F.col(f"_near.{c}").alias(c) for c in "rgb"], "cells")


def joined_neighbours(layers: DataFrame) -> DataFrame:
    """Layers that follow each other in one colour become one, which covers what any of them covers."""
    order = Window.partitionBy("image_id").orderBy("z")
    paint = F.struct("r", "g", "b")
    turns = layers.withColumn("turn", F.when(F.lag(paint).over(order) == paint, 0).otherwise(1))
    runs = turns.withColumn("run", F.sum("turn").over(order))
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_list("cells"))))
    return runs.groupBy("image_id", "run").agg(F.min("z").alias("z"), *[F.first(c).alias(c) for c in "rgb"], union.alias("cells")).drop("run")
