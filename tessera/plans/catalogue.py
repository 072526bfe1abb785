"""The engine's queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.colour import hex_colour, oklab
from tessera.operators import clusters as C
from tessera.operators import decisions as D
from tessera.operators import features as X
from tessera.operators import mosaic as M
from tessera.operators import palettes as A
from tessera.operators import paths as S
from tessera.operators import pixels as P
from tessera.operators import regions as R
from tessera.operators import watershed as W
from tessera.operators.borders import border_steps, half_edges, segments
from tessera.operators.fill import painted_pixels
from tessera.operators.runs import run_boxes
from tessera.operators.trees import tree_links
from tessera.plans.auto import auto_vectorise
from tessera.plans.oracles import PALETTE, SMALL_SIDE
from tessera.sources import rasters
from tessera.sources.scratch import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def on_pixels(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(rasters.embedding_pixels(spark, sf_dir))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(px: DataFrame) -> DataFrame:
    """Regions by the top two bits of red."""
    return px.select("image_id", "x", "y", F.shiftright("r", 6).alias("region"), "r", "g", "b")


def mask_by(px: DataFrame, condition: str) -> DataFrame:
    return px.select("image_id", "x", "y", F.expr(condition).cast("int").alias("fg"))


def features(px: DataFrame) -> DataFrame:
    return X.image_features(px)


QUERIES["pixels_from_embeddings"] = rasters.embedding_pixels
QUERIES["pixels_from_events"] = rasters.event_pixels
on_pixels("packed_images", lambda px: rasters.image_rows(px).select("image_id", "width", "height", F.md5(F.hex("rgba")).alias("rgba_md5")))
on_pixels("intensity", P.grey)
on_pixels("threshold_fixed", P.fixed_threshold)
on_pixels("sat", lambda px: P.summed_area(px).select("image_id", "x", "y", "sat"))
on_pixels("region_sum", lambda px: P.rectangle_sum(P.summed_area(px), F.col("x"), F.col("y"), F.col("x") + 7, F.col("y") + 7).select("image_id", "x", "y", "total"))
on_pixels("threshold_adaptive", P.adaptive_threshold)
on_pixels("key_decision", P.key_decision)
on_pixels("unused_colour", P.unused_colour)
on_pixels("apply_key", P.apply_key)
on_pixels("same_colour_edges", R.same_colour_edges)
on_pixels("edge_weight_histogram", R.edge_histogram)
on_pixels("boundary_pixels", lambda px: P.boundary(P.fixed_threshold(px)))
on_pixels("mask_facts", lambda px: P.mask_box(P.fixed_threshold(px)).join(P.boundary_facts(P.fixed_threshold(px)), "image_id"))
on_pixels("mask_crop", lambda px: P.cropped(P.fixed_threshold(px, 90)))
on_pixels("mask_negative", lambda px: P.negative(P.fixed_threshold(px)))
on_pixels("mask_union", lambda px: P.united(P.fixed_threshold(px, 110), mask_by(px, "r < 90")))
on_pixels("hole_punch", lambda px: P.punched(P.fixed_threshold(px, 110), mask_by(px, "r < 90")))
on_pixels("mask_picture", lambda px: P.picture_of(P.fixed_threshold(px)))
on_pixels("mask_from_picture", lambda px: P.mask_from_picture(P.picture_of(P.fixed_threshold(px))))
on_pixels("region_stats", lambda px: R.region_stats(labels(px)))
on_pixels("region_adjacency", lambda px: R.adjacency(labels(px)))
on_pixels("region_adjacency_bag", lambda px: R.adjacency(labels(px), distinct=False).groupBy("image_id", "a", "b").agg(F.count("*").alias("n")))
on_pixels("nearest_neighbour_region", lambda px: R.nearest_neighbour(labels(px)))
on_pixels("oklab_convert", lambda px: R.region_stats(labels(px)).select("image_id", "region", oklab(F.col("mean_r"), F.col("mean_g"), F.col("mean_b")).alias("k")).select("image_id", "region", *[F.round(f"k.{c}", 9).alias(c) for c in "lab"]))
on_pixels("palette_snap", lambda px: R.snapped(R.region_stats(labels(px)).select("image_id", "region", *[F.col(f"mean_{c}").alias(c) for c in "rgb"]), PALETTE).select("image_id", "region", "pr", "pg", "pb"))
on_pixels("hex_format", lambda px: R.region_stats(labels(px)).select("image_id", "region", hex_colour(F.col("mean_r"), F.col("mean_g"), F.col("mean_b")).alias("hex")))
on_pixels("lattice_nodes", lambda px: R.lattice_nodes(labels(px)))
on_pixels("downsample_nn", lambda px: X.sampled(px, SMALL_SIDE).select("image_id", "x", "y", "r", "g", "b", "a"))
on_pixels("colour_histogram_topk", lambda px: X.histogram_top(X.sampled(px)))
on_pixels("luma_percentiles", lambda px: X.luma_percentiles(X.sampled(px)))
on_pixels("colourfulness", lambda px: X.colourfulness(X.sampled(px)))
on_pixels("sobel_laplacian", lambda px: X.gradients(X.sampled(px)))
on_pixels("border_stddev", lambda px: X.border_spread(X.sampled(px)))
on_pixels("image_features", features)
on_pixels("class_scores", lambda px: D.class_scores(features(px)).select("image_id", "line_art", "flat_art", "photo"))
on_pixels("heuristic_decision", lambda px: D.heuristic_decision(features(px)))
on_pixels("scan_detector", lambda px: D.scan_direct(features(px)))
on_pixels("candidate_menu", lambda px: D.candidates(features(px)))


def rotated_menu(px: DataFrame) -> DataFrame:
    found = features(px)
    return D.presented(D.candidates(found), found).select("image_id", "goal", "letter", "family")


def letter_choice(px: DataFrame) -> DataFrame:
    """A model that always says " c": what it gets from each image's menu."""
    found = features(px)
    answers = found.select("image_id", F.explode(F.array(*map(F.lit, D.GOALS))).alias("goal"), F.lit(" c").alias("choice"))
    return D.chosen_by_letter(D.presented(D.candidates(found), found), answers).select("image_id", "goal", "family", "clustering", "filter_speckle", "layer_difference", "error")


on_pixels("rotated_menu", rotated_menu)
on_pixels("letter_choice", letter_choice)
on_pixels("decision_summary", lambda px: D.heuristic_decision(features(px)).select("image_id", "goal", D.summary().alias("line")))


@query("flatten_layers")
def flatten_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three masks over each other; the topmost paint of each covered cell."""
    px = rasters.embedding_pixels(spark, sf_dir)
    covers = F.filter(F.array(F.when(F.col("r") < 200, F.lit(0)), F.when(F.col("g") < 150, F.lit(1)), F.when(F.col("b") < 100, F.lit(2))), lambda z: z.isNotNull())
    return R.flattened(px.select("image_id", "x", "y", F.explode(covers).alias("z")).withColumn("paint", F.col("z") + 1))


@query("merge_adjacent_layers")
def merge_adjacent_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image row as a layer of its coarse mean colour; equal neighbours become one."""
    px = rasters.embedding_pixels(spark, sf_dir)
    coarse = [(F.floor(F.avg(c) / 16).cast("int") * 16).alias(c) for c in "rgb"]
    return R.merged_adjacent(px.groupBy("image_id", F.col("y").alias("z")).agg(*coarse, F.lit(255).alias("a"), F.count("*").alias("area")))


@query("config_clamp")
def config_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters brought back into their ranges."""
    v = F.floor("value")
    rows = read(spark, sf_dir, "events").select(
        "event_id", (v * 3 - 40).alias("filter_speckle"), (F.col("event_id") % 13 - 2).alias("color_precision"), v.cast("double").alias("segment_length"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100).alias("max_colors"),
    )
    return D.clamped(rows)


@query("svg_number_format")
def svg_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates as paths write them."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    return rows.select("vec_id", "pos", T.path_number(F.col("e").cast("double") * 4, 2).alias("num"))


@query("coordinate_quantise")
def coordinate_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half away from zero, to one digit."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.rounded_away(F.col("l_extendedprice"), 1).alias("price"))


@query("palette_parse")
def palette_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette texts of six- and three-digit colours and one token that is none."""
    m = F.md5("p_name")
    text = F.concat(F.substring(m, 1, 6), F.lit(", #"), F.substring(m, 7, 3), F.lit("\n zz"), F.substring(m, 1, 2))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.palette_tokens(text)).alias("pos", "token"))
    c = T.hex_channels(F.col("token"))
    return rows.select("p_partkey", "pos", "token", *[F.get(c, F.lit(k)).alias(n) for k, n in enumerate("rgb")])


@query("human_bytes")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes for people."""
    n = (F.floor("o_totalprice") * (F.col("o_orderkey") % 40)).cast("long")
    return read(spark, sf_dir, "orders").select("o_orderkey", T.human_bytes(n).alias("size"))


@query("save_name")
def save_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names from sources' names and times."""
    source = F.when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(F.concat("event_type", F.lit(".png")))
    return read(spark, sf_dir, "events").select("event_id", T.save_name(source, F.col("ts")).alias("name"))


@query("format_sniff")
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of contents by their first bytes."""
    heads = F.array(*[F.lit(h) for h in ("89504E470D0A1A0A", "FFD8FFE000104A46", "474946383961", "52494646000000005745425056503820", "424D0000", "00010203")])
    content = F.unhex(F.concat(heads[(F.col("s_suppkey") % 6).cast("int")], F.hex(F.encode("s_name", "utf-8"))))
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.image_format(content).alias("format"))


@query("svg_output_facts")
def svg_output_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an output SVG says of itself."""
    svg = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), F.length("url"), F.lit('" height="'), F.col("page_id") % 997,
        F.lit('"><path fill="#'), F.upper(F.substring(F.md5("url"), 1, 2)), F.lit('0000" d="M0,0Z"/><path fill="#00FF00" d="M1,1Z"/></svg>'),
    )
    return read(spark, sf_dir, "pages").select("page_id", svg.alias("svg")).select("page_id", *T.svg_facts(F.col("svg")))


@query("progress_latest")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the requests for one image, the newest, and how many there were."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.count("*").alias("superseded"))


@query("answer_parse")
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters out of a model's answers in three envelopes, among other words."""
    speckle = (2 + F.col("turn") % 3).cast("string")
    kind = F.when(F.col("turn") % 2 == 0, "binary").otherwise("color-cluster")
    args = F.concat(F.lit('{"filter_speckle": '), speckle, F.lit(', "clustering": "'), kind, F.lit('"}'))
    wrapped = F.when(F.col("turn") % 3 == 0, args).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"arguments": '), args, F.lit("}"))).otherwise(F.concat(F.lit('{"function_calls": [{"arguments": '), args, F.lit("}]}")))
    said = F.concat(F.lit("Here is the choice for turn "), F.col("turn").cast("string"), F.lit(":\n"), wrapped, F.lit("\nthat is all"))
    rows = D.answer_fields(read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("answer")))
    return rows.select("conv_id", "turn", F.col("answer_filter_speckle").cast("int").alias("filter_speckle"), F.col("answer_clustering").alias("clustering"))


# --- images to regions, outlines and documents ---------------------------------------------------


def noisy_layers(px: DataFrame) -> DataFrame:
    """Colour layers with keying, at settings for rough images."""
    return C.colour_layers(C.with_keyed(px), precision=5, difference=48, speckle=2)


on_pixels("connected_components", lambda px: run_boxes(C.connected_components(P.fixed_threshold(px, 110))))
on_pixels("connected_components_diagonal", lambda px: run_boxes(C.connected_components(P.fixed_threshold(px, 110), diagonal=True)))
on_pixels("watershed_mst_weights", lambda px: tree_links(px).groupBy("image_id", "weight").agg(F.count("*").alias("n")))
on_pixels("border_steps", lambda px: half_edges(labels(px)))
on_pixels("border_lengths", lambda px: M.border_lengths(segments(border_steps(labels(px)))).drop("first", "left", "top"))
on_pixels("region_outlines", lambda px: M.region_outlines(labels(px)))
on_pixels("outline_raster", lambda px: painted_pixels(M.region_paths(labels(px)), P.sizes(px)))
on_pixels("merge_tiles", lambda px: R.region_stats(M.merged_similar(px.select("image_id", "x", "y", F.expr("y div 4 * 16 + x div 4").cast("int").alias("region"), "r", "g", "b"), 16)))
on_pixels("watershed_regions", lambda px: R.region_stats(C.watershed_labels(px, 128)))
on_pixels("colour_cluster_layers", lambda px: noisy_layers(px).select("image_id", "z", "r", "g", "b", F.size("cells").alias("area")))
on_pixels("contours", lambda px: S.contours(C.binary_layers(P.fixed_threshold(px, 110), 2)))
on_pixels("polygons", lambda px: S.contours(C.binary_layers(P.fixed_threshold(px, 110), 2), "polygon"))
on_pixels("splines", lambda px: S.contours(C.binary_layers(P.fixed_threshold(px, 110), 2), "spline"))
on_pixels("svg_stacked_spline", lambda px: S.vectorised(noisy_layers(px), P.sizes(px), "spline", level=2))
on_pixels("svg_binary", lambda px: S.vectorised(C.binary_layers(P.fixed_threshold(px, 110), 2), P.sizes(px)))
on_pixels("svg_stacked_pixel", lambda px: S.vectorised(noisy_layers(px), P.sizes(px), level=2))
on_pixels("svg_stacked_polygon", lambda px: S.vectorised(noisy_layers(px), P.sizes(px), "polygon"))
on_pixels("svg_stacked_plain", lambda px: S.vectorised(noisy_layers(px), P.sizes(px), level=0))


on_pixels("merge_similar", lambda px: R.region_stats(M.merged_similar(C.watershed_labels(px, 128), 60)))
on_pixels("mosaic_segments", lambda px: M.border_segments(C.watershed_labels(px, 128)))
on_pixels("mosaic_faces", lambda px: M.region_paths(C.watershed_labels(px, 128)).select("image_id", "z", "path", F.size("points").alias("n")))
on_pixels("svg_cutout", lambda px: M.cutout(noisy_layers(px), P.sizes(px), "polygon"))
on_pixels("svg_cutout_spline", lambda px: M.cutout(noisy_layers(px), P.sizes(px), "spline", level=2))
on_pixels("watershed_layers", lambda px: W.watershed_layers(px).select("image_id", "z", "r", "g", "b", F.size("cells").alias("area")))
on_pixels("svg_watershed", lambda px: S.vectorised(W.watershed_layers(px, 100, 16), P.sizes(px), "polygon"))
on_pixels("median_cut", lambda px: A.joined_neighbours(A.quantised_layers(dealt(noisy_layers(px), "layers"), 6)).select("image_id", "z", "r", "g", "b", F.size("cells").alias("area")))
on_pixels("simplify_curves", lambda px: S.contours(C.binary_layers(P.fixed_threshold(px, 110), 2), "spline", simplify=2.0).select("image_id", "z", "path", F.size("points").alias("n")))
on_pixels("svg_auto", lambda px: auto_vectorise(px, "compact"))
