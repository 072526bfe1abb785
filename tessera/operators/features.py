"""Image features: one row of seventeen numbers for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.colour import luma
from tessera.functions.text import rounded_away
from tessera.operators.pixels import along_rows, down_columns, with_size

SAMPLES = 200  # per side, of the bound on samples


def sampled(pixels: DataFrame, side: int = SAMPLES) -> DataFrame:
    """Nearest-neighbour reduction to about side * side pixels: adds dw, dh and moves x, y to the small grid.

    A small cell (x, y) shows the pixel (x * w div dw, y * h div dh); each pixel
    finds the cells that show it, so nothing is joined.
    """
    scale = F.sqrt(F.col("w") * F.col("h") / float(side * side))
    small = [F.when(scale <= 1, F.col(c)).otherwise(F.greatest(F.lit(2), F.floor(F.col(c) / scale + 0.5).cast("int"))).alias(f"d{c}") for c in "wh"]
    # x * w div dw = px  <=>  ceil(px * dw / w) <= x < ceil((px + 1) * dw / w)
    def cells(p: str, w: str) -> str:
        return f"filter(sequence(({p} * d{w} + {w} - 1) div {w} - 1, (({p} + 1) * d{w} + {w} - 1) div {w}), q -> q >= 0 and q < d{w} and q * {w} div d{w} = {p})"

    placed = with_size(pixels).select("*", *small).withColumn("sx", F.expr(cells("x", "w"))).withColumn("sy", F.expr(cells("y", "h")))
    shown = placed.filter((F.size("sx") > 0) & (F.size("sy") > 0)).drop("x", "y")
    across = shown.withColumn("x", F.explode("sx")).drop("sx")
    down = across.withColumn("y", F.explode("sy")).drop("sy")
    return down.withColumns({c: F.col(c).cast("int") for c in "xy"})


def histogram_top(samples: DataFrame, k: int = 8) -> DataFrame:
    """(image_id, quantized_colors, palette_share_top8, dominant_color_share) over colours of four bits a channel."""
    bucket = F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4)
    counts = samples.groupBy("image_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    rank = Window.partitionBy("image_id").orderBy(F.desc("n"), "bucket")
    ranked = counts.withColumn("rank", F.row_number().over(rank))
    return ranked.groupBy("image_id").agg(
        F.count("*").cast("int").alias("quantized_colors"),
        (F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias("palette_share_top8"),
        (F.max("n") / F.sum("n")).alias("dominant_color_share"),
    )


def luma_level() -> Column:
    return luma(F.col("r"), F.col("g"), F.col("b"))


def luma_percentiles(samples: DataFrame) -> DataFrame:
    """(image_id, p5, p95) from a histogram of 32 bins, by the bin's middle."""
    bin_ = F.shiftright(F.greatest(F.lit(0), F.least(F.lit(255), luma_level())).cast("int"), 3)
    counts = samples.groupBy("image_id", bin_.alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("image_id").orderBy("bin")
    acc = counts.withColumn("acc", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy("image_id")))

    def at(p: float):
        # an image of a few samples can have a target of none, which the first bin meets even when it is empty
        target = F.floor(F.first("total") * p + 0.5)
        return F.when(target == 0, 4).otherwise(F.coalesce(F.min(F.when(F.col("acc") >= F.floor(F.col("total") * p + 0.5), F.col("bin"))) * 8 + 4, F.lit(255)))

    return acc.groupBy("image_id").agg(at(0.05).alias("p5"), at(0.95).alias("p95"))


def opponents() -> list[Column]:
    """Sums for ``colourful``: means of the opponent channels and of their squares."""
    rg, yb = F.col("r") - F.col("g"), 0.5 * (F.col("r") + F.col("g")) - F.col("b")
    return [F.avg(rg).alias("m1"), F.avg(yb).alias("m2"), F.avg(rg * rg).alias("s1"), F.avg(yb * yb).alias("s2")]


def colourful() -> Column:
    v = [F.greatest(F.lit(0.0), F.col(f"s{k}") - F.col(f"m{k}") * F.col(f"m{k}")) for k in (1, 2)]
    return (F.sqrt(v[0] + v[1]) + 0.3 * F.sqrt(F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2"))).alias("colorfulness")


def colourfulness(samples: DataFrame) -> DataFrame:
    """(image_id, colorfulness) from means and spreads of the opponent channels."""
    return samples.groupBy("image_id").agg(*opponents()).select("image_id", colourful())


def with_gradients(samples: DataFrame) -> DataFrame:
    """``samples`` with ``grad`` and ``lap`` of a 3x3 Sobel and Laplacian of luma; null on the rim."""
    near = samples.withColumn("tc_", luma_level())
    near = near.withColumns({"tl_": F.lag("tc_").over(along_rows()), "tr_": F.lead("tc_").over(along_rows())})
    up = {f"u{n}": F.lag(f"t{n}_").over(down_columns()) for n in "lcr"}
    down = {f"d{n}": F.lead(f"t{n}_").over(down_columns()) for n in "lcr"}
    full = near.withColumns(up | down)
    c = F.col
    gx = (c("ur") + 2 * c("tr_") + c("dr")) - (c("ul") + 2 * c("tl_") + c("dl"))
    gy = (c("dl") + 2 * c("dc") + c("dr")) - (c("ul") + 2 * c("uc") + c("ur"))
    made = {"grad": F.sqrt(gx * gx + gy * gy) / 8, "lap": F.abs((c("uc") + c("dc") + c("tl_") + c("tr_")) - 4 * c("tc_"))}
    return full.withColumns(made).drop("tc_", "tl_", "tr_", *up, *down)


def gradient_facts() -> list[Column]:
    """Over the samples that are not on the rim."""
    g, flat = F.col("grad"), F.col("grad") < 24
    n = F.count("grad")
    return [
        F.coalesce(F.avg(g), F.lit(0.0)).alias("mean_gradient"), F.coalesce(F.try_divide(F.count_if(g > 48), n), F.lit(0.0)).alias("edge_density"),
        F.coalesce(F.try_divide(F.count_if(flat), n), F.lit(0.0)).alias("flat_share"), F.coalesce(F.avg(F.when(flat, F.col("lap"))), F.lit(0.0)).alias("noise_level"),
    ]


def gradients(samples: DataFrame) -> DataFrame:
    """(image_id, mean_gradient, edge_density, flat_share, noise_level)."""
    return with_gradients(samples).groupBy("image_id").agg(*gradient_facts())


def on_border() -> Column:
    """Whether a sample is on a frame of a twelfth of the shorter side."""
    wide = F.greatest(F.lit(1), F.floor(F.least("dw", "dh") * 0.08 + 0.5).cast("int"))
    return (F.col("x") < wide) | (F.col("y") < wide) | (F.col("x") >= F.col("dw") - wide) | (F.col("y") >= F.col("dh") - wide)


def border_spread(samples: DataFrame) -> DataFrame:
    """(image_id, background_uniformity): spread of luma on the frame."""
    return samples.groupBy("image_id").agg(F.stddev_pop(F.when(on_border(), luma_level())).alias("background_uniformity"))


def image_features(pixels: DataFrame, side: int = SAMPLES) -> DataFrame:
    """All features, in one aggregation over the samples.

    The luma histogram is 32 counts, the colour histogram a set of (bucket, how
    many) of 4096 at most.  Images of two samples across have no inner pixels;
    their gradient features are zero.
    """
    bucket = F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4)
    level = F.shiftright(F.greatest(F.lit(0), F.least(F.lit(255), luma_level())).cast("int"), 3)
    s = with_gradients(sampled(pixels, side)).withColumn("bucket", bucket)
    s = s.withColumn("alike", F.count("*").over(Window.partitionBy("image_id", "bucket")))
    n = F.count("*")
    main = s.groupBy("image_id").agg(
        F.first("w").alias("width"), F.first("h").alias("height"), (F.count_if(F.col("a") < 250) / n).alias("transparent_share"),
        (F.count_if(luma_level() < 64) / n).alias("dark_share"), (F.count_if(luma_level() > 192) / n).alias("light_share"),
        F.stddev_pop(F.when(on_border(), luma_level())).alias("background_uniformity"), *opponents(), *gradient_facts(),
        n.alias("n"), F.array(*[F.count_if(level == k) for k in range(32)]).alias("levels"), F.transform(F.collect_set(F.struct("bucket", "alike")), lambda x: x["alike"]).alias("buckets"),
    ).withColumn("colorfulness", colourful())

    def percentile(p: float) -> Column:
        target = F.floor(F.col("n") * p + 0.5)
        none = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("bins"))
        # the bins that fall short of the target come before the one that meets it
        short = F.aggregate("levels", none, lambda s, k: F.struct((s["acc"] + k).alias("acc"), (s["bins"] + (s["acc"] + k < target).cast("int")).alias("bins")), lambda s: s["bins"])
        return F.when(short < 32, short * 8 + 4).otherwise(255)

    top = F.aggregate(F.slice(F.sort_array("buckets", asc=False), 1, 8), F.lit(0).cast("long"), lambda s, k: s + k)
    made = {
        "quantized_colors": F.size("buckets"), "palette_share_top8": top / F.col("n"), "dominant_color_share": F.array_max("buckets") / F.col("n"),
        "luminance_spread": (percentile(0.95) - percentile(0.05)).cast("double"),
        "megapixels": F.col("width") * F.col("height") / 1000000, "aspect_ratio": F.col("width") / F.col("height"),
    }
    return main.withColumns(made).select(*FEATURES)


FEATURES = ["image_id", "width", "height", "megapixels", "aspect_ratio", "quantized_colors", "palette_share_top8", "dominant_color_share", "edge_density", "mean_gradient", "flat_share", "noise_level", "colorfulness", "transparent_share", "luminance_spread", "dark_share", "light_share", "background_uniformity"]
#: Digits of a feature where it is written out.
DIGITS = {"megapixels": 2, "aspect_ratio": 2, "palette_share_top8": 3, "dominant_color_share": 3, "edge_density": 3, "mean_gradient": 1, "flat_share": 3, "noise_level": 1, "colorfulness": 1, "transparent_share": 3, "luminance_spread": 1, "dark_share": 3, "light_share": 3, "background_uniformity": 1}


def rounded_payload(features: DataFrame) -> DataFrame:
    return features.withColumns({c: rounded_away(F.col(c), d) for c, d in DIGITS.items()})
