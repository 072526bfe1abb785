"""Graphs of many images at once, as tables of links; every step is a join, and rounds end when nothing changes.

A node is a long within its image, named by a pixel.  No image is gathered in one
task: tiles of bounded size are decided first, and what leaves them goes through
rounds.  A round's work is dealt by image and node, and its table is written to
the shared folder, so that lineage stays short and a lost executor costs one
round at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tiles import TILE, forest, least_labels, tile_of
from tessera.sources.scratch import dealt, discarded, written_counting

OF = "image_id"


def both_ways(links: DataFrame) -> DataFrame:
    """links(image_id, a, b, ...) and their opposites."""
    others = [c for c in links.columns if c not in (OF, "a", "b")]
    return links.select(OF, "a", "b", *others).union(links.select(OF, F.col("b").alias("a"), F.col("a").alias("b"), *others))


def components(links: DataFrame, side: int = TILE) -> DataFrame:
    """(image_id, node, label) of every node of links(image_id, a, b): the smallest node that can be reached.

    Labels are found within each tile first; pieces of several tiles are then
    linked, and spread their labels in rounds.
    """
    ends = links.select(OF, "a", "b", tile_of(F.col("a"), side).alias("tile"), tile_of(F.col("b"), side).alias("b_tile"))
    both = F.array(F.struct("tile", "a", F.col("a").alias("b"), F.lit(True).alias("crosses")), F.struct(F.col("b_tile").alias("tile"), F.col("b").alias("a"), "b", F.lit(True).alias("crosses")))
    own = F.array(F.struct("tile", "a", "b", F.lit(False).alias("crosses")))
    held = ends.select(OF, F.explode(F.when(F.col("tile") == F.col("b_tile"), own).otherwise(both)).alias("l")).select(OF, "l.*")

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        crosses = np.zeros(len(names), bool)
        crosses[at[pdf["crosses"].to_numpy(), 0]] = True
        return pd.DataFrame({OF: key[0], "node": names, "label": names[least_labels(len(names), at[:, 0], at[:, 1])], "crosses": crosses})

    labels, crossing = written_counting(held.groupBy(OF, "tile").applyInPandas(within, f"{OF} long, node long, label long, crosses boolean"), "labels", F.col("crosses"))
    if not crossing:
        return labels.drop("crosses")
    at = labels.filter("crosses").select(OF, "node", "label")
    met = ends.filter("tile <> b_tile").join(at.select(OF, F.col("node").alias("a"), F.col("label").alias("la")), [OF, "a"]).join(at.select(OF, F.col("node").alias("b"), F.col("label").alias("lb")), [OF, "b"])
    spread = spread_labels(met.select(OF, F.col("la").alias("a"), F.col("lb").alias("b"))).select(OF, F.col("node").alias("label"), F.col("label").alias("far"))
    return labels.join(spread, [OF, "label"], "left").select(OF, "node", F.coalesce("far", "label").alias("label"))


def spread_labels(links: DataFrame) -> DataFrame:
    """As ``components``, in rounds alone.

    Each round a node takes the smallest label among its neighbours, then its
    label's own label, so that chains shorten by halves.
    """
    edges = dealt(both_ways(links.select(OF, "a", "b")).distinct(), "links")
    labels = dealt(edges.groupBy(OF, F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    table = labels
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), [OF, "b"]).groupBy(OF, F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, [OF, "node"]).select(OF, "node", F.col("label").alias("was"), F.least("label", "heard").alias("near"))
        far = near.join(labels.select(OF, F.col("node").alias("near"), F.col("label").alias("far")), [OF, "near"])
        step, moved = written_counting(far.select(OF, "node", "was", F.least("near", "far").alias("label")), "labels", F.expr("was <> label"))
        discarded(table)
        table, labels = step, step.select(OF, "node", "label")
        if not moved:
            discarded(edges)
            return labels


def rooted(parents: DataFrame) -> DataFrame:
    """(image_id, node, root) of a forest parents(image_id, node, parent), where a root is its own parent: pointers jump until all are there."""
    table = dealt(parents.select(OF, "node", "parent"), "forest")
    while True:
        ahead = table.select(OF, F.col("node").alias("parent"), F.col("parent").alias("far"))
        far = table.join(ahead, [OF, "parent"]).select(OF, "node", F.col("far").alias("parent"), (F.col("far") != F.col("parent")).alias("moved"))
        step, moved = written_counting(far, "forest", F.col("moved"))
        discarded(table)
        table = step
        if not moved:
            return step.select(OF, "node", F.col("parent").alias("root"))


def spanning_forest(links: DataFrame, side: int = TILE) -> DataFrame:
    """The links (image_id, a, b, weight, ident, ...) of each image's minimum spanning forest, by (weight, ident).

    ``ident`` tells links apart within an image, so the forest is the one that
    taking links in that order gives.  What a tile's own forest leaves out is the
    largest of a cycle and in no forest; images with links between tiles go on in
    rounds with what is left.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema.fields) + ", crosses boolean"
    columns = links.columns

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        own = ~pdf["crosses"].to_numpy()
        names, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)[own]
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((pdf["ident"].to_numpy()[own], pdf["weight"].to_numpy()[own]))] = np.arange(len(at))
        left = np.ones(len(pdf), bool)
        left[own] = forest(len(names), at[:, 0], at[:, 1], rank)
        return pdf.loc[left, [*columns, "crosses"]]

    tiles = {"tile": tile_of(F.col("a"), side), "crosses": tile_of(F.col("a"), side) != tile_of(F.col("b"), side)}
    rest, crossing = written_counting(links.withColumns(tiles).groupBy(OF, "tile").applyInPandas(within, schema), "tile-forests", F.col("crosses"))
    if not crossing:
        return rest.select(*columns)
    large = rest.filter("crosses").select(OF).distinct()
    return rest.join(large, OF, "left_anti").select(*columns).union(forest_in_rounds(rest.join(large, OF, "left_semi").select(*columns)))


def forest_in_rounds(links: DataFrame) -> DataFrame:
    """As ``spanning_forest``, by Borůvka's rounds alone.

    Each round every tree takes its least link to another one; taken links join
    trees, whose labels the remaining links carry.  Trees at least halve in
    number, links within a tree are left out.
    """
    columns = links.columns
    rest, left = written_counting(links.select(OF, F.col("a").alias("ta"), F.col("b").alias("tb"), "weight", "ident", F.struct(*columns).alias("row")), "forest-links", F.lit(True))
    taken = None
    while left:
        ways = rest.select(OF, F.col("ta").alias("tree"), "tb", "weight", "ident", "row").union(rest.select(OF, F.col("tb").alias("tree"), F.col("ta").alias("tb"), "weight", "ident", "row"))
        least = dealt(ways.groupBy(OF, "tree").agg(F.min_by(F.struct("tb", "row"), F.struct("weight", "ident")).alias("l")).select(OF, "tree", "l.tb", "l.row"), "forest-least")
        taken = least.select("row") if taken is None else taken.union(least.select("row"))
        # two trees that chose each other chose the same link: the smaller one is the root
        back = least.select(OF, F.col("tree").alias("tb"), F.col("tb").alias("back"))
        hooked = least.join(back, [OF, "tb"], "left").select(OF, F.col("tree").alias("node"), F.when((F.col("back") == F.col("tree")) & (F.col("tree") < F.col("tb")), F.col("tree")).otherwise(F.col("tb")).alias("parent"))
        roots = rooted(hooked)
        moved = rest.join(roots.select(OF, F.col("node").alias("ta"), F.col("root").alias("ra")), [OF, "ta"]).join(roots.select(OF, F.col("node").alias("tb"), F.col("root").alias("rb")), [OF, "tb"])
        next_, left = written_counting(moved.filter("ra <> rb").select(OF, F.col("ra").alias("ta"), F.col("rb").alias("tb"), "weight", "ident", "row"), "forest-links", F.lit(True))
        discarded(rest)
        rest = next_
    if taken is None:
        return links.limit(0)
    return taken.distinct().select("row.*")
