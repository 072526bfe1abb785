"""What keeps memory, traffic and the driver bounded as tables grow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import mosaic as M
from tessera.operators.borders import border_steps, face_order
from tessera.operators.graphs import components, forest_in_rounds, spanning_forest, spread_labels
from tessera.operators.runs import labelled_runs, meeting, numbered, row_runs
from tessera.operators.trees import pixel_links
from tessera.plans.auto import segmented
from tessera.sources import rasters


def test_tasks_follow_the_number_of_images(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "IMAGES_PER_TASK", 2, raising=False)
    vectors = spark.range(40 * 64).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.01), 64).cast("array<float>").alias("embedding"))
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    held = rasters.embedding_pixels(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("image_id").alias("n"), F.count("*").alias("cells")).collect()
    assert sum(r.n for r in held) == 40 and sum(r.cells for r in held) == 40 * 64 * 64
    assert len(held) > 8 and max(r.n for r in held) <= 10


def random_images(spark, n=3, w=11, h=9):
    r = np.random.default_rng(5)
    rows = [(k, x, y, int(v)) for k in range(n) for (y, x), v in np.ndenumerate(r.integers(0, 2 + k, (h, w)))]
    rows += [(9, x, y, int(2 < x < 9 and 2 < y < 7)) for y in range(h) for x in range(w)]  # a ring over many tiles
    return spark.createDataFrame(rows, "image_id long, x int, y int, region int")


def sorted_rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def test_borders_are_the_same_over_small_tiles(spark):
    px = random_images(spark)
    whole, tiled = border_steps(px), border_steps(px, 3)
    assert sorted_rows(whole) == sorted_rows(tiled)
    assert sorted_rows(face_order(whole)) == sorted_rows(face_order(tiled, 2))


def test_components_and_forests_are_the_same_over_small_tiles(spark):
    px = random_images(spark)
    links = meeting(row_runs(px, "region"), True)
    assert sorted_rows(components(links)) == sorted_rows(components(links, 2)) == sorted_rows(spread_labels(links))
    edges = pixel_links(px.select("image_id", "x", "y", *[(F.col("region") * 40).alias(c) for c in "rgb"]))
    assert sorted_rows(spanning_forest(edges)) == sorted_rows(spanning_forest(edges, 3)) == sorted_rows(forest_in_rounds(edges))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_tables_are_never_broadcast(spark):
    px = random_images(spark)
    for found in (M.region_paths(px.select("*", *[F.lit(0).alias(c) for c in "rgb"])), numbered(labelled_runs(px, "region")), components(meeting(row_runs(px, "region")), 2)):
        found.collect()
        assert "BroadcastExchange" not in plan_of(found)


def test_layers_are_found_once(spark):
    colours = [((F.col("x") * k + F.col("y") * 7) % 256).cast("int").alias(c) for k, c in zip((9, 31, 77), "rgb")]
    px = random_images(spark, 1).select("image_id", "x", "y", *colours, F.lit(255).alias("a"))
    setting = {"clustering": "color", "color_precision": 6, "layer_difference": 16, "filter_speckle": 1, "binary_threshold": 128, "binary_adaptive": False, "max_colors": 4}
    chosen = px.select("image_id").distinct().select("image_id", *[F.lit(v).alias(k) for k, v in setting.items()])
    found = segmented(px, chosen)  # only the palettes' kernel is left in the plan
    assert plan_of(found).split("Initial Plan")[0].count("FlatMapGroupsIn") == 1
    assert {tuple(c) for r in found.collect() for c in r.cells} == {(r.y, r.x) for r in px.collect()}
