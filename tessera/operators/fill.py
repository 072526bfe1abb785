"""Scan-line filling of outlines: crossings of each pixel line as rows, inside and outside by their parity along the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graphs import OF

#: Chords that stand for one cubic.
CHORDS = 12


def chorded(points: Column, cubic: Column) -> Column:
    """An outline's points, cubics (1 + 3n points) as chords."""
    n = F.floor((F.size(points) - 1) / 3).cast("int")

    def on_curve(i: Column) -> Column:
        k = F.least(F.floor(i / CHORDS).cast("int"), n - 1)
        t = i / F.lit(float(CHORDS)) - k
        p = [F.get(points, 3 * k + j) for j in range(4)]
        weights = [(1 - t) * (1 - t) * (1 - t), 3 * t * (1 - t) * (1 - t), 3 * t * t * (1 - t), t * t * t]
        return F.struct(*[sum((w * q[c] for w, q in zip(weights[1:], p[1:])), weights[0] * p[0][c]).alias(c) for c in "xy"])

    return F.when(cubic & (n > 0), F.transform(F.sequence(F.lit(0), n * CHORDS), on_curve)).otherwise(points)


def crossings(paths: DataFrame) -> DataFrame:
    """(image_id, z, y, at): where the outlines of paths(image_id, z, path, points, cubic) cross the middle of a pixel line; open ones are closed."""
    line = paths.select(OF, "z", chorded(F.col("points"), F.col("cubic")).alias("points")).filter(F.size("points") > 1)
    n = F.size("points")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", (i + 1) % n).alias("b")))
    edge = line.select(OF, "z", F.explode(sides).alias("s")).select(OF, "z", "s.a", "s.b").filter("a.y <> b.y")
    first, last = F.ceil(F.least("a.y", "b.y") - 0.5), F.ceil(F.greatest("a.y", "b.y") - 0.5) - 1
    crossed = edge.filter(last >= first).select(OF, "z", "a", "b", F.explode(F.sequence(first, last)).alias("y"))
    share = (F.col("y") + 0.5 - F.col("a.y")) / (F.col("b.y") - F.col("a.y"))
    return crossed.select(OF, "z", F.col("y").cast("int").alias("y"), (F.col("a.x") + share * (F.col("b.x") - F.col("a.x"))).alias("at"))


def filled_runs(paths: DataFrame) -> DataFrame:
    """(image_id, z, y, x0, x1): the runs of pixels whose middle lies inside an odd number of the layer's outlines."""
    along = Window.partitionBy(OF, "z", "y").orderBy("at")
    spans = crossings(paths).withColumns({"n": F.row_number().over(along), "end": F.lead("at").over(along)}).filter("n % 2 = 1 and end is not null")
    runs = spans.select(OF, "z", "y", F.ceil(F.col("at") - 0.5).cast("int").alias("x0"), (F.ceil(F.col("end") - 0.5) - 1).cast("int").alias("x1"))
    return runs.filter("x1 >= x0")


def painted_pixels(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b) of paths with paints, within sizes(image_id, w, h): the topmost layer's paint of each covered pixel."""
    paints = paths.select(OF, "z", "r", "g", "b").distinct()
    runs = filled_runs(paths).join(sizes, OF).filter("y >= 0 and y < h").select(OF, "z", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("w") - 1).alias("x1"))
    cells = runs.filter("x1 >= x0").select(OF, "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    top = cells.groupBy(OF, "x", "y").agg(F.max("z").alias("z"))
    return top.join(paints, [OF, "z"]).select(OF, "x", "y", "r", "g", "b")


def scaled(paths: DataFrame, sizes: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Paths and sizes brought into ``cap`` pixels a side, in proportion, one pixel at least."""
    k = F.least(F.lit(1.0), F.lit(float(cap)) / F.greatest("w", "h"))
    small = sizes.select(OF, k.alias("k"), *[F.greatest(F.lit(1), F.floor(F.col(c) * k + 0.5).cast("int")).alias(c) for c in "wh"])
    moved = paths.join(small.select(OF, "k"), OF).withColumn("points", F.transform("points", lambda p: F.struct((p["x"] * F.col("k")).alias("x"), (p["y"] * F.col("k")).alias("y")))).drop("k")
    return moved, small.drop("k")


def preview(paths: DataFrame, sizes: DataFrame, cap: int = 256) -> DataFrame:
    """(image_id, x, y, r, g, b): outlines as they look in ``cap`` pixels a side."""
    return painted_pixels(*scaled(paths, sizes, cap))
