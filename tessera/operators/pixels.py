"""Per-pixel operators over pixels(image_id, x, y, r, g, b, a) and masks(image_id, x, y, fg).

Windows run along rows and columns of an image; on pixels that stand together by
image_id none of them needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.colour import intensity


def along_rows() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def down_columns() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def grey_level() -> Column:
    return intensity(F.col("r"), F.col("g"), F.col("b"))


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, w, h)."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def with_size(pixels: DataFrame) -> DataFrame:
    """``pixels`` with their image's w and h; where an image stands together, this needs no shuffle."""
    image = Window.partitionBy("image_id")
    return pixels.withColumns({"w": F.max("x").over(image) + 1, "h": F.max("y").over(image) + 1})


def grey(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "x", "y", grey_level().alias("v"))


def fixed_threshold(pixels: DataFrame, value: int = 128) -> DataFrame:
    """Foreground is darker than ``value``."""
    return pixels.select("image_id", "x", "y", (grey_level() < value).cast("int").alias("fg"))


def summed_area(pixels: DataFrame) -> DataFrame:
    """Inclusive sums of grey levels over the rectangle from the origin: along rows, then down columns."""
    along = grey(pixels).withColumn("s", F.sum(F.col("v").cast("long")).over(along_rows()))
    return along.select("image_id", "x", "y", "v", F.sum("s").over(down_columns()).alias("sat"))


def rectangle_sum(sat: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> DataFrame:
    """``sat`` (image_id, x, y, sat, ...) with ``total`` over each row's inclusive rectangle, clipped to the image.

    A rectangle needs two rows of the summed areas: the one above it and its
    last.  They are joined by image and row, each as one array, so that a pixel
    meets two lines of its image, never the whole of it.
    """
    lines = sat.groupBy("image_id", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "sat"))), lambda p: p["sat"]).alias("line"))
    last = F.max("y").over(Window.partitionBy("image_id"))
    own = sat.select(F.struct(*sat.columns).alias("row"), "image_id", left.alias("x0"), right.alias("x1"), (top - 1).alias("above"), F.least(bottom, last).alias("below"))

    def at(line: str, x: Column) -> Column:
        return F.when((x < 0) | F.col(line).isNull(), F.lit(0).cast("long")).otherwise(F.get(line, F.least(x, F.size(line) - 1)))

    both = own
    for name in ("above", "below"):
        both = both.join(lines.select("image_id", F.col("y").alias(name), F.col("line").alias(f"line_{name}")), ["image_id", name], "left")
    total = at("line_below", F.col("x1")) - at("line_below", F.col("x0") - 1) - at("line_above", F.col("x1")) + at("line_above", F.col("x0") - 1)
    return both.select(*[F.col("row")[c].alias(c) for c in sat.columns], total.alias("total"))


def box_sums(sized: DataFrame, half: Column) -> DataFrame:
    """``sized`` (image_id, x, y, v, w, h) with ``total`` over the square of ``half`` pixels on each side, clipped to the image.

    Along rows, then down columns: in each the running sums of one line stand in
    an array, and a sum is the difference of two of them.
    """
    now = sized.withColumn("s", F.col("v").cast("long"))
    for window, line, at, size in ((along_rows(), "y", "x", "w"), (down_columns(), "x", "y", "h")):
        run = now.withColumn("run", F.sum("s").over(window))
        lines = run.groupBy("image_id", line).agg(F.first("w").alias("w"), F.first("h").alias("h"), F.sort_array(F.collect_list(F.struct(at, "v", "run"))).alias("cells"))
        lines = lines.withColumn("half", half)

        def cell(p: Column) -> Column:
            to = F.get("cells", F.least(F.col(size) - 1, p[at] + F.col("half")))["run"]  # noqa: B023
            before = F.get("cells", p[at] - F.col("half") - 1)["run"]  # noqa: B023
            return F.struct(p[at].alias(at), p["v"].alias("v"), (to - F.coalesce(before, F.lit(0))).alias("s"))  # noqa: B023

        now = lines.select("image_id", line, "w", "h", F.inline(F.transform("cells", cell)))
    return now.withColumnRenamed("s", "total")


def adaptive_threshold(pixels: DataFrame, window: int = 0, percent: float = 15.0) -> DataFrame:
    """Foreground is not lighter than the window's mean less ``percent``; window 0 is an eighth of the shorter side.

    The window is clipped to the image.
    """
    factor = 1.0 - min(100.0, max(0.0, percent)) / 100.0
    half = F.lit(window // 2) if window else F.expr("greatest(1, least(w, h) div 8) div 2").cast("int")
    summed = box_sums(with_size(grey(pixels)), half).withColumn("half", half)

    def extent(at: str, size: str) -> Column:
        return F.least(F.col(size) - 1, F.col(at) + F.col("half")) - F.greatest(F.lit(0), F.col(at) - F.col("half")) + 1

    return summed.select("image_id", "x", "y", (F.col("v") * extent("x", "w") * extent("y", "h") <= F.col("total") * factor).cast("int").alias("fg"))


def key_decision(pixels: DataFrame) -> DataFrame:
    """(image_id, keyed): whether five sampled rows hold enough transparent pixels; a row that is sampled twice counts twice."""
    rows = F.array(F.lit(0), F.expr("h div 4"), F.expr("h div 2"), F.expr("3 * h div 4"), F.col("h") - 1)
    times = F.size(F.filter(rows, lambda q: q == F.col("y")))
    clear = with_size(pixels).groupBy("image_id").agg(F.first("w").alias("w"), F.sum(F.when(F.col("a") == 0, times).otherwise(0)).alias("n"))
    return clear.select("image_id", (F.col("n") >= F.floor(F.col("w") * 2 * 0.2)).alias("keyed"))


# Key colours tried first; then a sweep by steps of 37.
SPECIALS = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (0, 255, 255), (255, 0, 255))


def unused_colour(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b): the first candidate that no pixel has; nulls if all are taken.

    Only an image's own candidates are looked at: those it has are struck from the list.
    """
    packed = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    sweep = [(r, g, b) for r in range(0, 256, 37) for g in range(0, 256, 37) for b in range(0, 256, 37)]
    codes = [r * 65536 + g * 256 + b for r, g, b in (*SPECIALS, *sweep)]
    candidates = F.array(*[F.lit(c) for c in codes])
    taken = pixels.select("image_id", packed.alias("c")).groupBy("image_id").agg(F.collect_set(F.when(F.col("c").isin(codes), F.col("c"))).alias("taken"))
    first = F.get(F.array_except(candidates, F.col("taken")), F.lit(0))
    return taken.select("image_id", first.alias("c")).selectExpr("image_id", "c div 65536 as r", "c div 256 % 256 as g", "c % 256 as b").select("image_id", *[F.col(c).cast("int") for c in "rgb"])


def apply_key(pixels: DataFrame) -> DataFrame:
    """Transparent pixels take their image's unused colour, opaque."""
    keys = unused_colour(pixels).select("image_id", *[F.col(c).alias(f"k{c}") for c in "rgb"])
    out = pixels.join(keys, "image_id")
    return out.select("image_id", "x", "y", *[F.when(F.col("a") == 0, F.col(f"k{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"], F.when(F.col("a") == 0, 255).otherwise(F.col("a")).alias("a"))


def boundary(mask: DataFrame) -> DataFrame:
    """Set pixels with a clear neighbour, one of four; beyond the image, and where a cell has no row, all is clear."""
    clear = F.lit(False)
    for window, at in ((along_rows(), "x"), (down_columns(), "y")):
        for step, shift in ((F.lag, -1), (F.lead, 1)):
            set_ = (step(at).over(window) == F.col(at) + shift) & (step("fg").over(window) == 1)
            clear = clear | ~F.coalesce(set_, F.lit(False))
    return mask.withColumn("edge", clear).filter("fg = 1 and edge").select("image_id", "x", "y")


def boundary_facts(mask: DataFrame) -> DataFrame:
    """(image_id, first_x, first_y, length) of the boundary, first in raster order."""
    return boundary(mask).groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("p"), F.count("*").alias("length")).select("image_id", F.col("p.x").alias("first_x"), F.col("p.y").alias("first_y"), "length")


def mask_box(mask: DataFrame) -> DataFrame:
    """(image_id, area, left, top, right, bottom) of the set pixels; right and bottom exclusive."""
    return mask.filter("fg = 1").groupBy("image_id").agg(
        F.count("*").alias("area"), F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("bottom")
    )


def cropped(mask: DataFrame) -> DataFrame:
    """The mask within its own box, moved to the origin."""
    box = mask_box(mask)
    inside = mask.join(box, "image_id").filter("x >= left and x < right and y >= top and y < bottom")
    return inside.select("image_id", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"), "fg")


def negative(mask: DataFrame) -> DataFrame:
    return mask.select("image_id", "x", "y", (1 - F.col("fg")).alias("fg"))


def to_pixels(mask: DataFrame) -> DataFrame:
    """Black on white, opaque."""
    v = F.when(F.col("fg") == 1, 0).otherwise(255)
    return mask.select("image_id", "x", "y", v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"))


def united(one: DataFrame, other: DataFrame) -> DataFrame:
    """Set pixels of either mask."""
    return one.filter("fg = 1").select("image_id", "x", "y").union(other.filter("fg = 1").select("image_id", "x", "y")).distinct()


def punched(mask: DataFrame, holes: DataFrame) -> DataFrame:
    """Set pixels of ``mask`` that ``holes`` does not set."""
    return mask.filter("fg = 1").select("image_id", "x", "y").join(holes.filter("fg = 1"), ["image_id", "x", "y"], "left_anti")


def mask_from_picture(pictures: DataFrame) -> DataFrame:
    """masks of pictures(image_id, picture): * is set; empty lines are skipped, the first other line gives the width."""
    lines = pictures.select("image_id", F.filter(F.split("picture", "\n", -1), lambda s: s != "").alias("lines"))
    rows = lines.select("image_id", F.length(F.get("lines", F.lit(0))).alias("w"), F.posexplode("lines").alias("y", "line"))
    cells = rows.select("image_id", "y", "line", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    return cells.select("image_id", "x", "y", (F.substring(F.col("line"), F.col("x") + 1, F.lit(1)) == "*").cast("int").alias("fg"))


def picture_of(mask: DataFrame) -> DataFrame:
    """pictures(image_id, picture) of masks, a line end after each row."""
    sign = F.when(F.col("fg") == 1, "*").otherwise("-")
    rows = mask.groupBy("image_id", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", sign.alias("c")))), lambda p: p["c"]), "").alias("line"))
    return rows.groupBy("image_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "line"))), lambda p: p["line"]), "\n"), F.lit("\n")).alias("picture"))
