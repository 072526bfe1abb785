"""Merging of regions over their adjacency graph, in rounds; pixels are only touched before and after.

The rounds of an image with at most WHOLE regions are gone through in one group;
those of larger images are joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.colour import difference
from tessera.operators.graphs import OF, both_ways
from tessera.operators.regions import RGB, adjacency
from tessera.operators.runs import pixel_name
from tessera.sources.scratch import dealt, discarded, written, written_counting

SUMS = [f"sum_{c}" for c in RGB]
#: Regions of an image up to which it is merged in one group, which this bounds whatever the size of the table.
WHOLE = 16_384


def mean_struct() -> Column:
    """A region's truncated mean colour, out of its sums and area."""
    return F.struct(*[F.expr(f"sum_{c} div area").alias(c) for c in RGB])


def region_sums(labels: DataFrame) -> DataFrame:
    """(image_id, region, area, sum_r, sum_g, sum_b, first) of labels(image_id, x, y, region, r, g, b); ``first`` names the first pixel."""
    sums = [F.sum(F.col(c).cast("long")).alias(f"sum_{c}") for c in RGB]
    return labels.filter("region is not null").groupBy(OF, "region").agg(F.count("*").alias("area"), *sums, F.min(pixel_name()).alias("first"))


def contracted(stats: DataFrame, links: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stats`` and ``links`` after each region of moves(image_id, region, root) has joined its root; the tables before are deleted."""
    at = F.coalesce("root", "region").alias("region")
    totals = [F.sum(c).alias(c) for c in ("area", *SUMS)]
    next_stats = dealt(stats.join(moves, [OF, "region"], "left").select(OF, at, "area", *SUMS, "first").groupBy(OF, "region").agg(*totals, F.min("first").alias("first")), "regions")
    for end in "ab":
        moved = moves.select(OF, F.col("region").alias(end), F.col("root").alias(f"to_{end}"))
        links = links.join(moved, [OF, end], "left").withColumn(end, F.coalesce(f"to_{end}", end)).drop(f"to_{end}")
    next_links = dealt(links.filter("a <> b").select(OF, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "touching")
    return next_stats, next_links


def nearest_pairs(stats: DataFrame, links: DataFrame, limit: Column | None) -> DataFrame:
    """(image_id, region, other) of each region's nearest neighbour by mean colour, at most ``limit`` away; of equals the pair named least."""
    means = stats.select(OF, "region", mean_struct().alias("mean"))
    far = links.join(means.select(OF, F.col("region").alias("a"), F.col("mean").alias("ma")), [OF, "a"]).join(means.select(OF, F.col("region").alias("b"), F.col("mean").alias("mb")), [OF, "b"])
    far = far.withColumn("diff", difference([F.col(f"ma.{c}") for c in RGB], [F.col(f"mb.{c}") for c in RGB]))
    near = far if limit is None else far.filter(F.col("diff") <= limit)
    ways = both_ways(near.select(OF, "a", "b", "diff"))
    return ways.groupBy(OF, F.col("a").alias("region")).agg(F.min_by("b", F.struct("diff", F.least("a", "b"), F.greatest("a", "b"))).alias("other"))


def rounds_within(sums: np.ndarray, area: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The root of each region of one image, by the rounds of ``merged_regions``; regions are numbered in the order of their names."""
    root, sums, area = np.arange(len(area)), sums.copy(), area.copy()
    while True:
        means = np.sign(sums) * (np.abs(sums) // area[:, None])
        diff = np.abs(means[a] - means[b]).sum(1)
        at = diff <= most
        one, two, diff = np.r_[a[at], b[at]], np.r_[b[at], a[at]], np.r_[diff[at], diff[at]]
        if not len(one):
            return root
        order = np.lexsort((np.maximum(one, two), np.minimum(one, two), diff, one))
        one, two = one[order], two[order]
        least = np.r_[True, one[1:] != one[:-1]]
        region, other = one[least], two[least]
        nearest, joined = np.full(len(root), -1), np.full(len(root), -1)
        nearest[region] = other
        mutual = nearest[other] == region
        joined[region[mutual]] = np.minimum(region, other)[mutual]
        to = np.arange(len(root))
        to[region] = np.where(joined[other] >= 0, joined[other], region)
        moved = np.flatnonzero(to != np.arange(len(root)))
        np.add.at(sums, to[moved], sums[moved])
        np.add.at(area, to[moved], area[moved])
        root = to[root]
        a, b = np.minimum(to[a], to[b]), np.maximum(to[a], to[b])
        a, b = np.unique(np.stack([a, b], 1)[a != b], axis=0).T


def merged_within(stats: DataFrame, links: DataFrame) -> DataFrame:
    """(image_id, region, root) of stats(image_id, region, area, sums, most) and links(image_id, a, b), an image in each group."""
    region = stats.schema["region"].dataType

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        most = one.column("most")[0].as_py() if one.num_rows else None
        order = np.argsort(one.column("region").to_numpy(), kind="stable")
        one = one.take(order)
        names = one.column("region").to_numpy()
        known = np.logical_and.reduce([~np.asarray(one.column(c).is_null()) for c in SUMS])
        a, b = (np.searchsorted(names, two.column(c).to_numpy()) for c in "ab")
        # a region without colour is near to none
        fit = known[a] & known[b] if most is not None else np.zeros(len(a), bool)
        sums = np.stack([one.column(c).fill_null(0).to_numpy() for c in SUMS], 1)
        root = names[rounds_within(sums, one.column("area").to_numpy(), a[fit], b[fit], most or 0)]
        return pa.table({OF: one.column(OF), "region": one.column("region"), "root": pa.array(root, one.schema.field("region").type)})

    schema = f"{OF} {stats.schema[OF].dataType.simpleString()}, region {region.simpleString()}, root {region.simpleString()}"
    slim = stats.select(OF, "region", "area", *SUMS, "most").groupBy(OF)
    return slim.cogroup(links.select(OF, "a", "b").groupBy(OF)).applyInArrow(run, schema)


def with_means(roots: DataFrame, stats: DataFrame) -> DataFrame:
    """roots(image_id, region, root) with the mean colour and first pixel of each root's row of ``stats``."""
    out = roots.join(stats.select(OF, F.col("region").alias("root"), mean_struct().alias("m"), "first"), [OF, "root"])
    return out.select(OF, "region", "root", *[F.col(f"m.{c}").cast("int").alias(f"mean_{c}") for c in RGB], "first")


def merged_regions(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(image_id, region, root, mean_r, mean_g, mean_b, first): neighbouring regions whose means differ by ``most`` at most become one.

    In each round every two regions that are each other's nearest neighbour merge,
    and with them the regions whose nearest neighbour is one of the two, so that a
    large region takes all its like at once; then differences are taken anew,
    until no neighbours are near enough.  The closest pair of an image is always
    such a pair, so each round makes an end nearer.  A sequential merge that goes
    through the pairs in the order of their first differences may end in other
    regions where three or more are near each other.  ``most`` null: each image's
    own layer_difference.
    """
    stats = dealt(region_sums(labels), "regions")
    links = dealt(adjacency(labels), "touching")
    limits = None if most is not None else written(labels.groupBy(OF).agg(F.first("layer_difference").alias("most")), "limits")
    large = written(stats.groupBy(OF).agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE).select(OF), "large")
    some_large = not large.isEmpty()
    small, small_links = (t.join(large, OF, "left_anti") if some_large else t for t in (stats.filter(f"{OF} is not null"), links))
    roots = dealt(merged_within(small.withColumn("most", F.lit(most)) if limits is None else small.join(limits, OF), small_links), "roots")
    totals = [F.sum(c).alias(c) for c in ("area", *SUMS)]
    merged = small.join(roots, [OF, "region"]).groupBy(OF, F.col("root").alias("region")).agg(*totals, F.min("first").alias("first"))
    whole = with_means(roots, merged)
    if not some_large:
        return whole
    return whole.unionByName(merged_by_joins(dealt(stats.join(large, OF), "regions"), dealt(links.join(large, OF), "touching"), limits, most))


def merged_by_joins(stats: DataFrame, links: DataFrame, limits: DataFrame | None, most: int | None) -> DataFrame:
    """``merged_regions`` of images of any size, whose rounds are joins; the tables given are deleted on the way."""
    roots = dealt(stats.select(OF, "region", F.col("region").alias("root")), "roots")
    while True:
        held = links if limits is None else links.join(limits, OF)
        near = nearest_pairs(stats, held, F.lit(most) if limits is None else F.col("most"))
        near = dealt(near, "nearest")
        back = near.select(OF, F.col("region").alias("other"), F.col("other").alias("back"))
        pairs = near.join(back, [OF, "other"]).filter("back = region").select(OF, "region", F.least("region", "other").alias("root"))
        joining = near.join(pairs.select(OF, F.col("region").alias("other"), "root"), [OF, "other"]).join(pairs.select(OF, "region"), [OF, "region"], "left_anti").select(OF, "region", "root")
        moves, n = written_counting(pairs.filter("region <> root").union(joining), "moves", F.lit(True))
        discarded(near)
        if not n:
            return with_means(roots, stats)
        next_stats, next_links = contracted(stats, links, moves)
        step = roots.join(moves.select(OF, F.col("region").alias("root"), F.col("root").alias("to")), [OF, "root"], "left")
        next_roots = dealt(step.select(OF, "region", F.coalesce("to", "root").alias("root")), "roots")
        discarded(stats, links, roots, moves)
        stats, links, roots = next_stats, next_links, next_roots


def merged_similar(labels: DataFrame, most: int) -> DataFrame:
    """labels(image_id, x, y, region, r, g, b) with similar neighbours merged, regions numbered anew in raster order, r, g, b their means.

    Images may bring their own layer_difference in place of ``most``.
    """
    merged = merged_regions(labels, None if "layer_difference" in labels.columns else most)
    number = F.dense_rank().over(Window.partitionBy(OF).orderBy("first")) - 1
    merged = dealt(merged.withColumn("number", number.cast("int")), "merged").select(OF, "region", "number", *[f"mean_{c}" for c in RGB])
    others = [c for c in labels.columns if c not in (OF, "x", "y", "region", *RGB)]
    return labels.join(merged, [OF, "region"]).select(OF, "x", "y", F.col("number").alias("region"), *[F.col(f"mean_{c}").alias(c) for c in RGB], *others)
