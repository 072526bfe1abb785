"""Flat partitions of images: shared borders are found and fitted once, and each region's outline is put together from them.

A border runs between lattice nodes, the corners where three or more borders
meet; a border without a node is a ring.  Finding borders, outlines and islands
and putting them together are joins; only the fit of one border is Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.borders import border_steps, face_order, segments
from tessera.operators.curves import chain, corners_of, spline, thinned_chain
from tessera.operators.graphs import OF
from tessera.operators.merging import merged_similar
from tessera.operators.paths import POINTS, documents_of, thinned, without_stairs
from tessera.operators.runs import labelled_runs, pixel_name, run_cells
from tessera.sources.scratch import dealt

Corner = tuple[int, int]
#: What an image may bring of its own, and its default's name in ``region_paths``.
OWN_SETTINGS = {"fit_mode": "mode", "corner_threshold": "corner", "segment_length": "length", "splice_threshold": "splice", "simplify": "simplify"}


def border_segments(labels: DataFrame) -> DataFrame:
    """(image_id, segment, region_right, region_left, points) of labels(image_id, x, y, region); the left one is null outside."""
    found = segments(border_steps(labels))
    return found.select(OF, F.col("number").alias("segment"), "region_right", "region_left", "points")


def border_lengths(found: DataFrame) -> DataFrame:
    """(image_id, segment, first, region_right, region_left, steps, corners, area2, left, top) of ``segments``: area2 is twice the signed area below the line."""
    at = F.sequence(F.lit(1), F.size("points") - 1)
    twice = F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get("points", i - 1)["x"] * F.get("points", i)["y"] - F.get("points", i)["x"] * F.get("points", i - 1)["y"])
    least = [F.array_min(F.transform("points", lambda p: p[c])).cast("int").alias(name) for c, name in (("x", "left"), ("y", "top"))]
    return found.select(OF, F.col("number").alias("segment"), "first", "region_right", "region_left", "steps", F.size("points").alias("corners"), twice.cast("long").alias("area2"), *least)


def region_outlines(labels: DataFrame) -> DataFrame:
    """(image_id, region, left, top, length, area2) of each outline of each region; a region's areas, holes negative, make its own."""
    steps = border_steps(labels)
    facts = border_lengths(segments(steps)).select(OF, F.col("first").alias("segment"), "left", "top", "steps", "area2")
    area = F.when(F.col("forward"), F.col("area2")).otherwise(-F.col("area2"))
    around = face_order(steps).join(facts, [OF, "segment"]).groupBy(OF, "region", "cycle")
    return around.agg(F.min("left").alias("left"), F.min("top").alias("top"), F.sum("steps").alias("length"), F.sum(area).alias("area2")).drop("cycle")


def island_cells(labels: DataFrame) -> DataFrame:
    """(image_id, x, y, island): for each cell, the first cell of the piece of its region that it can be reached in, eight ways."""
    return run_cells(labelled_runs(labels.filter("region is not null"), "region", diagonal=True), "label").withColumnRenamed("label", "island")


def fitted(points: list[Corner], mode: str, corner: float, length: float, splice: float) -> tuple[list[complex], bool]:
    """A border's points, and whether they are cubics; the ends of an open border stay where they are."""
    ring = points[0] == points[-1]
    if mode == "pixel":
        return [complex(*p) for p in points], False
    simple = thinned(without_stairs(points, True) if ring and mode == "spline" else points)
    if mode == "polygon" or len(simple) < 3 or (ring and len(simple) < 5):
        return [complex(*p) for p in simple], False
    if ring:
        return spline(simple, corner, length, 10, splice), True
    line = [complex(*p) for p in simple]
    sharp = [0, *(i for i, c in enumerate(corners_of(line, corner)) if c and 0 < i < len(line) - 1), len(line) - 1]
    out = line[:1]
    for a, b in zip(sharp, sharp[1:]):
        for c in chain(line[a : b + 1], 1.0):
            out += c[1:]
    return out, True


def fitted_segments(found: DataFrame, settings: dict[str, object]) -> DataFrame:
    """(image_id, segment, shape, curved): the borders' points after fitting; ``found`` has the settings as columns, null for the default."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            shapes, curved = [], []
            for row in pdf.itertuples(index=False):
                own = {k: settings[k] if pd.isna(getattr(row, k)) else getattr(row, k) for k in OWN_SETTINGS}
                sharp = math.radians(own["corner_threshold"])
                points, cubic = fitted([(int(p["x"]), int(p["y"])) for p in row.points], own["fit_mode"], sharp, own["segment_length"], math.radians(own["splice_threshold"]))
                if cubic and points and own["simplify"] > 0:
                    points = thinned_chain(points, own["simplify"], sharp)
                shapes.append([{"x": p.real, "y": p.imag} for p in points])
                curved.append(cubic)
            yield pd.DataFrame({OF: pdf[OF], "segment": pdf["first"], "shape": shapes, "curved": curved})

    return found.select(OF, "first", "points", *OWN_SETTINGS).mapInPandas(run, f"{OF} long, segment long, shape {POINTS}, curved boolean")


def along(part: Column, cubic: Column) -> Column:
    """A border's points in the outline's direction; a straight piece among curves is written as one, with its ends for control points."""
    straight = part["shape"]
    n = F.size(straight)
    doubled = F.concat(F.slice(straight, 1, 1), F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array(F.get(straight, i - 1), F.get(straight, i), F.get(straight, i)))))
    points = F.when(cubic & ~part["curved"] & (n > 1), doubled).otherwise(straight)
    return F.when(part["forward"], points).otherwise(F.reverse(points))


def region_paths(labels: DataFrame, mode: str = "pixel", corner: float = 60, length: float = 4.0, splice: float = 45, simplify: float = 0.0) -> DataFrame:
    """paths of labels(image_id, x, y, region, r, g, b): outlines out of borders that are each fitted once.

    A face is an island of a region; z numbers the faces by region and then in
    raster order.  Images may bring fit_mode, corner_threshold, segment_length,
    splice_threshold and simplify of their own as columns.
    """
    defaults = {"mode": mode, "corner": corner, "length": length, "splice": splice, "simplify": simplify}
    settings = {k: defaults[v] for k, v in OWN_SETTINGS.items()}
    own = [k for k in OWN_SETTINGS if k in labels.columns]
    labels = dealt(labels, "labels")
    steps = border_steps(labels)
    kinds = {k: "string" if k == "fit_mode" else "double" for k in OWN_SETTINGS}
    images = labels.groupBy(OF).agg(*[F.first(k).cast(kinds[k]).alias(k) if k in own else F.lit(None).cast(kinds[k]).alias(k) for k in OWN_SETTINGS])
    shapes = fitted_segments(segments(steps).join(images, OF), settings)

    # an outline belongs to the island of the cell on the right of where it begins
    right = {0: (0, 0), 1: (-1, 0), 2: (-1, -1), 3: (0, -1)}
    order = face_order(steps)
    cell = [F.coalesce(*[F.when(F.col("d") == d, F.col(c) + by[k]) for d, by in right.items()]).alias(c) for k, c in enumerate("xy")]
    begins = order.filter("place = 0").select(OF, "region", "cycle", *cell).join(island_cells(labels), [OF, "x", "y"])
    z = F.dense_rank().over(Window.partitionBy(OF).orderBy("region", "island")) - 1
    path = F.row_number().over(Window.partitionBy(OF, "region", "island").orderBy("cycle")) - 1
    outlines = begins.select(OF, "region", "cycle", z.cast("int").alias("z"), path.cast("int").alias("path"))

    pieces = order.select(OF, "region", "cycle", "place", "segment", "forward").join(shapes, [OF, "segment"])
    piece = F.struct("place", "forward", "curved", "shape")
    lines = pieces.groupBy(OF, "region", "cycle").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("curved").alias("cubic"))
    first = F.transform("pieces", lambda p: along(p, F.col("cubic")))
    joined = F.concat(F.element_at(first, 1), F.flatten(F.transform(F.slice(first, F.lit(2), F.size(first)), lambda p: F.slice(p, F.lit(2), F.size(p)))))
    first_cell = F.min_by(F.struct(*[F.col(c).cast("int").alias(c) for c in "rgb"]), pixel_name())
    paints = labels.groupBy(OF, "region").agg(first_cell.alias("paint")).select(OF, "region", "paint.*")
    made = lines.select(OF, "region", "cycle", joined.alias("points"), "cubic").join(outlines.hint("merge"), [OF, "region", "cycle"]).join(paints, [OF, "region"])
    return made.select(OF, "z", "r", "g", "b", "path", "points", "cubic")


def labels_of_layers(layers: DataFrame) -> DataFrame:
    """The topmost layer of each covered cell, as labels(image_id, x, y, region, r, g, b)."""
    cells = layers.select("image_id", "z", "r", "g", "b", F.explode("cells").alias("c"))
    top = cells.groupBy("image_id", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.max(F.struct("z", "r", "g", "b")).alias("t"))
    return top.select("image_id", "x", "y", F.col("t.z").alias("region"), "t.r", "t.g", "t.b")


def cutout(layers: DataFrame, sizes: DataFrame, mode: str = "pixel", most: int = 16, level: int = 1, digits: int = 2, **curve: float) -> DataFrame:
    """(image_id, svg) of layers as a flat partition without gaps or overlaps."""
    labels = merged_similar(labels_of_layers(layers), most)
    return documents_of(region_paths(labels, mode, **curve), sizes, level, digits)
