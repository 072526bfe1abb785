"""Regions of labelled images: labels(image_id, x, y, region, r, g, b), region null where nothing lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.colour import difference, edge_weight, lab_distance, oklab, same_colour
from tessera.operators.pixels import along_rows, down_columns

RGB = ["r", "g", "b"]


def neighbours(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each cell and its neighbour to the right or below: ``columns``, and the neighbour's as ``n_``."""
    found = []
    for window, step in ((along_rows(), "x"), (down_columns(), "y")):
        after = cells.withColumns({f"n_{c}": F.lead(c).over(window) for c in columns} | {"n_at": F.lead(step).over(window)})
        found.append(after.filter(F.col("n_at") == F.col(step) + 1).drop("n_at"))
    return found[0].union(found[1])


def edge_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, weight, n): how often neighbours differ by a weight."""
    pairs = neighbours(pixels, RGB)
    weight = edge_weight([F.col(c) for c in RGB], [F.col(f"n_{c}") for c in RGB])
    return pairs.groupBy("image_id", weight.alias("weight")).agg(F.count("*").alias("n"))


def same_colour_edges(pixels: DataFrame, precision: int = 6) -> DataFrame:
    """(image_id, n, same): neighbours, and those of the same colour at a precision of so many bits."""
    same = same_colour([F.col(c) for c in RGB], [F.col(f"n_{c}") for c in RGB], 8 - precision)
    return neighbours(pixels, RGB).groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


def region_stats(labels: DataFrame) -> DataFrame:
    """Area, sums, mean colour (truncated) and box of each region."""
    sums = labels.filter("region is not null").groupBy("image_id", "region").agg(
        F.count("*").alias("area"), *[F.sum(F.col(c).cast("long")).alias(f"sum_{c}") for c in RGB],
        F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("bottom"),
    )
    return sums.withColumns({f"mean_{c}": F.expr(f"cast(sum_{c} div area as int)") for c in RGB})


def adjacency(labels: DataFrame, distinct: bool = True) -> DataFrame:
    """(image_id, a, b), a < b: regions that touch; with ``distinct`` False, once for each pair of cells."""
    pairs = neighbours(labels, ["region"]).filter("region <> n_region")
    out = pairs.select("image_id", F.least("region", "n_region").alias("a"), F.greatest("region", "n_region").alias("b"))
    return out.distinct() if distinct else out


def nearest_neighbour(labels: DataFrame) -> DataFrame:
    """(image_id, region, target, diff): each region's neighbour of the nearest mean colour, ranked by diff * 65535 + region."""
    stats = region_stats(labels).select("image_id", "region", *[f"mean_{c}" for c in RGB])
    touching = adjacency(labels)
    both = touching.union(touching.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    own = stats.select("image_id", F.col("region").alias("a"), *[F.col(f"mean_{c}").alias(f"a_{c}") for c in RGB])
    far = stats.select("image_id", F.col("region").alias("b"), *[F.col(f"mean_{c}").alias(f"b_{c}") for c in RGB])
    ranked = both.join(own, ["image_id", "a"]).join(far, ["image_id", "b"]).withColumn("diff", difference([F.col(f"a_{c}") for c in RGB], [F.col(f"b_{c}") for c in RGB]))
    best = F.min_by(F.struct("b", "diff"), F.col("diff") * F.lit(65535).cast("long") + F.col("b"))
    return ranked.groupBy("image_id", F.col("a").alias("region")).agg(best.alias("t")).select("image_id", "region", F.col("t.b").alias("target"), F.col("t.diff").alias("diff"))


def flattened(layers: DataFrame) -> DataFrame:
    """The topmost paint of each cell of layers(image_id, z, x, y, paint)."""
    return layers.groupBy("image_id", "x", "y").agg(F.max_by("paint", "z").alias("paint"), F.max("z").alias("z"))


def merged_adjacent(layers: DataFrame) -> DataFrame:
    """Runs of layers(image_id, z, r, g, b, a, area) with equal paint become one: (image_id, z, r, g, b, a, layers, area)."""
    order = Window.partitionBy("image_id").orderBy("z")
    paint = F.struct("r", "g", "b", "a")
    flagged = layers.withColumn("turn", F.when(F.lag(paint).over(order) == paint, 0).otherwise(1))
    run = flagged.withColumn("run", F.sum("turn").over(order))
    return run.groupBy("image_id", "run").agg(
        F.min("z").alias("z"), *[F.first(c).alias(c) for c in ("r", "g", "b", "a")], F.count("*").alias("layers"), F.sum("area").alias("area")
    ).drop("run")


def snapped(colours: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """``colours`` with pr, pg, pb: the palette's nearest colour in OKLab, the first of equals."""
    own = oklab(*[F.col(c) for c in RGB])
    entries = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(c) for c, v in zip(RGB, rgb)], oklab(*[F.lit(v) for v in rgb]).alias("lab")) for i, rgb in enumerate(palette)])
    ranked = F.transform(entries, lambda p: F.struct(lab_distance(F.col("_lab"), p["lab"]).alias("d"), p["i"].alias("i"), *[p[c].alias(c) for c in RGB]))
    return colours.withColumn("_lab", own).withColumn("_near", F.array_min(ranked)).select(*colours.columns, *[F.col(f"_near.{c}").alias(f"p{c}") for c in RGB])


def lattice_nodes(labels: DataFrame) -> DataFrame:
    """(image_id, x, y, degree): lattice corners where three or more region borders meet; outside is a region of its own."""
    cells = labels.select("image_id", "x", "y", F.coalesce("region", F.lit(-1)).alias("region"))
    corners = cells.select(
        "image_id", "region",
        F.explode(F.array(*[F.struct((F.col("x") + dx).alias("cx"), (F.col("y") + dy).alias("cy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(((1, 1), (0, 1), (1, 0), (0, 0)))])).alias("c"),
    )
    # the four cells around a corner: above left, above right, below left, below right
    around = corners.groupBy("image_id", F.col("c.cx").alias("x"), F.col("c.cy").alias("y")).agg(
        *[F.coalesce(F.max(F.when(F.col("c.k") == k, F.col("region"))), F.lit(-1)).alias(f"q{k}") for k in range(4)]
    )

    def differ(a: int, b: int) -> Column:
        return (F.col(f"q{a}") != F.col(f"q{b}")).cast("int")

    degree = differ(0, 1) + differ(1, 3) + differ(3, 2) + differ(2, 0)
    return around.select("image_id", "x", "y", degree.alias("degree")).filter("degree >= 3")
