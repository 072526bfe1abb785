"""Borders of labelled images as half-edges: a row for each directed unit step, its region on the right.

Their order along a border is found within tiles of bounded size; what a border
has in several tiles is put together by pointer jumping, so that no image is
gathered in one task and rounds are only for images that are larger than a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graphs import OF
from tessera.operators.runs import STRIDE
from tessera.operators.tiles import LINE_BITS, TILE, chain_places, places_of, tile_of
from tessera.sources.scratch import dealt, discarded, written_counting

OUTSIDE = -1
POINT = "struct<x:double,y:double>"


def step_name(x: Column, y: Column, d: Column | int) -> Column:
    """Names ascend by lattice corner in raster order, then by direction: east, south, west, north."""
    return (y.cast("long") * STRIDE + x) * 4 + d


def half_edges(labels: DataFrame) -> DataFrame:
    """(image_id, x, y, d, hx, hy, right, left) of labels(image_id, x, y, region): steps from corner (x, y) to (hx, hy), both ways.

    A null region, and what has no cell, is outside: -1.
    """
    cells = labels.select(OF, "x", "y", F.coalesce("region", F.lit(OUTSIDE)).alias("region"))

    def side(k: Column, low: Column, high: Column) -> Column:
        return F.struct(k.alias("k"), low.alias("low"), high.alias("high"))

    found = []
    for line, at, fixed, down in ((Window.partitionBy(OF, "y").orderBy("x"), "x", "y", 1), (Window.partitionBy(OF, "x").orderBy("y"), "y", "x", 0)):
        near = cells.withColumns({"p_at": F.lag(at).over(line), "p_region": F.lag("region").over(line), "n_at": F.lead(at).over(line)})
        here, before = F.col("region"), F.when(F.col("p_at") == F.col(at) - 1, F.col("p_region")).otherwise(F.lit(OUTSIDE))
        ends = F.col("n_at").isNull() | (F.col("n_at") != F.col(at) + 1)
        sides = F.array(side(F.col(at), before, here), F.when(ends, side(F.col(at) + 1, here, F.lit(OUTSIDE))))
        border = near.select(OF, F.col(fixed).alias("f"), F.explode(F.filter(sides, lambda s: s["low"] != s["high"])).alias("s")).select(OF, "f", "s.*")
        if down:  # between two cells of a line: south has the left cell on its right, north the right one
            ways = [(F.col("k"), F.col("f"), 1, F.col("k"), F.col("f") + 1, "low", "high"), (F.col("k"), F.col("f") + 1, 3, F.col("k"), F.col("f"), "high", "low")]
        else:  # between two cells of a column: east has the lower cell on its right, west the upper one
            ways = [(F.col("f"), F.col("k"), 0, F.col("f") + 1, F.col("k"), "high", "low"), (F.col("f") + 1, F.col("k"), 2, F.col("f"), F.col("k"), "low", "high")]
        both = F.array(*[
            F.struct(x.alias("x"), y.alias("y"), F.lit(d).alias("d"), hx.alias("hx"), hy.alias("hy"), F.col(right).alias("right"), F.col(left).alias("left"))
            for x, y, d, hx, hy, right, left in ways
        ])
        found.append(border.select(OF, F.explode(both).alias("w")).select(OF, "w.*"))
    return found[0].union(found[1])


def joined_chains(links: DataFrame) -> DataFrame:
    """(image_id, chain, whole, before, total, ring) of links(image_id, chain, leads, size, least): chains that lead on to each other, by pointer jumping.

    ``leads`` is used once each.  A whole begins with the chain that nothing
    leads to and has its name; a ring begins with the chain that has the smallest
    ``least``.  ``before`` counts what stands in front of a chain.
    """
    columns = [F.col("chain").alias("node"), F.col("leads").alias("ahead"), "least", F.col("chain").alias("last"), F.col("size").alias("n")]
    table = dealt(links.select(OF, *columns), "walk")
    while True:
        far = table.select(OF, F.col("node").alias("ahead"), F.col("ahead").alias("f_ahead"), F.col("least").alias("f_least"), F.col("last").alias("f_last"), F.col("n").alias("f_n"))
        met = table.join(far, [OF, "ahead"], "left")
        least = F.least("least", "f_least")
        step, moved = written_counting(
            met.select(
                OF, "node", F.col("f_ahead").alias("ahead"), least.alias("least"), F.coalesce("f_last", "last").alias("last"),
                (F.col("n") + F.coalesce("f_n", F.lit(0))).alias("n"), (F.col("f_ahead").isNotNull() & (least != F.col("least"))).alias("moved"),
                (F.col("ahead").isNotNull() & F.col("f_ahead").isNull()).alias("ended"),
            ), "walk", F.col("moved") | F.col("ended"),
        )
        discarded(table)
        table = step
        if not moved:
            break
    # open ones: n counts what is left to the end, the end names the whole
    open_ = table.filter("ahead is null").select(OF, F.col("node").alias("chain"), F.col("last").alias("end"), "n")
    heads = open_.groupBy(OF, "end").agg(F.max_by("chain", "n").alias("whole"), F.max("n").alias("total"))
    out = open_.join(heads, [OF, "end"]).select(OF, "chain", "whole", (F.col("total") - F.col("n")).alias("before"), "total", F.lit(False).alias("ring"))
    rings = table.filter("ahead is not null").select(OF, F.col("node").alias("chain"), F.col("least").alias("ring_least"))
    if rings.isEmpty():
        return out
    held = dealt(links.join(rings, [OF, "chain"]), "rings")
    starts = held.filter("least = ring_least").select(OF, F.col("chain").alias("leads"), F.lit(True).alias("start"))
    cut = held.join(starts, [OF, "leads"], "left").select(OF, "chain", F.when(F.col("start").isNull(), F.col("leads")).alias("leads"), "size", "least")
    return out.union(joined_chains(cut).select(OF, "chain", "whole", "before", "total", F.lit(True)))


def ranked_along(steps: DataFrame, tile: Column) -> DataFrame:
    """``steps`` (image_id, node, next, ...) without next, with chain, place, size and ring; each next is used once: list ranking.

    ``chain`` is the first node of a chain, or the smallest of a ring, where a
    ring begins; ``place`` counts from there.  Chains are first found within each
    ``tile``; only those that leave their tile go through rounds.
    """
    kept = [f for f in steps.schema.fields if f.name != "next"]
    names = [f.name for f in kept]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        node, next_ = pdf["node"].to_numpy(), pdf["next"].to_numpy()
        onward = next_ >= 0
        ahead = np.where(onward, places_of(node, next_), -1)
        head, place, size, ring, last = chain_places(node, ahead)
        out = pdf[names].assign(chain=head, place=place, size=size, ring=ring)
        return out.assign(leads=pd.arrays.IntegerArray(next_, ~(onward & (ahead < 0))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", chain long, place long, size long, ring boolean, leads long"
    tiled = steps.withColumns({"tile": tile, "next": F.coalesce("next", F.lit(-1).cast("long"))}).groupBy(OF, "tile").applyInPandas(within, schema)
    table, leaving = written_counting(tiled, "ranked", F.col("leads").isNotNull())
    if not leaving:
        return table.drop("leads")
    ways = table.filter("leads is not null").select(OF, "chain", "leads")
    touched = ways.select(OF, "chain").union(ways.select(OF, F.col("leads").alias("chain"))).distinct()
    facts = table.join(touched, [OF, "chain"]).groupBy(OF, "chain").agg(F.max("leads").alias("leads"), F.max("size").alias("size"), F.min("node").alias("least"), F.min_by("place", "node").alias("least_at"))
    facts = dealt(facts, "chains")
    whole = joined_chains(facts.drop("least_at")).withColumnRenamed("ring", "closed")
    # a ring begins at its smallest node, which may stand within its first chain
    start = facts.select(OF, F.col("chain").alias("whole"), F.col("least").alias("first"), F.col("least_at").alias("shift"))
    found = whole.join(start, [OF, "whole"]).select(OF, "chain", F.when(F.col("closed"), F.col("first")).otherwise(F.col("whole")).alias("whole"), "before", "total", "closed", F.when(F.col("closed"), F.col("shift")).otherwise(0).alias("shift"))
    out = table.drop("leads").join(dealt(found, "wholes"), [OF, "chain"], "left")
    place = F.when(F.col("total").isNull(), F.col("place")).otherwise(F.pmod(F.col("before") + F.col("place") - F.col("shift"), F.col("total")))
    return out.select(*names, F.coalesce("whole", "chain").alias("chain"), place.alias("place"), F.coalesce("total", "size").alias("size"), F.coalesce("closed", "ring").alias("ring"))


def border_steps(labels: DataFrame, side: int = TILE) -> DataFrame:
    """Half-edges with their place along a border: (image_id, name, x, y, d, hx, hy, right, left, segment, place, size, ring).

    A border goes from node to node, corners where three or more steps meet, or
    is a ring; ``segment`` names it by its first step.
    """
    steps = half_edges(labels).withColumn("name", step_name(F.col("x"), F.col("y"), F.col("d")))
    corner = Window.partitionBy(OF, "x", "y")
    met = steps.withColumns({"degree": F.count("*").over(corner), "all": F.sum("name").over(corner)})
    # at a corner of degree 2, what comes in by the way back of one step goes on by the other
    other = F.when(F.col("degree") == 2, F.col("all") - F.col("name"))
    coming = met.select(OF, back_step().alias("node"), other.alias("next"), F.col("left").alias("right"), F.col("right").alias("left"))
    walked = ranked_along(coming, tile_of(F.shiftright("node", 2), side))
    d, at = F.col("node").bitwiseAND(3).cast("int"), F.shiftright("node", 2)
    x, y = at.bitwiseAND(STRIDE - 1).cast("int"), F.shiftright(at, LINE_BITS).cast("int")
    hx, hy = x + F.when(d == 0, 1).when(d == 2, -1).otherwise(0), y + F.when(d == 1, 1).when(d == 3, -1).otherwise(0)
    return walked.select(OF, F.col("node").alias("name"), x.alias("x"), y.alias("y"), d.alias("d"), hx.alias("hx"), hy.alias("hy"), "right", "left", F.col("chain").alias("segment"), "place", "size", "ring")


def back_step() -> Column:
    """The name of the way back over a step."""
    return step_name(F.col("hx"), F.col("hy"), (F.col("d") + 2) % 4)


def twins() -> list[Column]:
    """Of all steps of a border: its sides, the first step of its way back (``twin``), by the last step or, for a ring, the least."""
    twin = F.when(F.col("ring"), F.min(back_step())).otherwise(F.max_by(back_step(), "place"))
    return [twin.alias("twin"), F.first("right").alias("right"), F.first("left").alias("left")]


def is_kept() -> Column:
    """Of the two directions of every border the one that is kept: it has the earlier first step, and for a ring a region on its right."""
    first = F.col("segment") < F.col("twin")
    return F.when(F.col("ring") & (F.col("right") == OUTSIDE), F.lit(False)).when(F.col("ring") & (F.col("left") == OUTSIDE), F.lit(True)).otherwise(first)


def segments(steps: DataFrame) -> DataFrame:
    """(image_id, segment, first, region_right, region_left, points, steps, ring): each border once, its corners where the direction changes.

    Borders are numbered from node to node first, then the rings, each by its
    first step ``first``; region_left is null outside.
    """
    line = Window.partitionBy(OF, "segment").orderBy("place")
    turns = steps.withColumn("before", F.lag("d").over(line)).withColumn("last", F.col("place") == F.col("size") - 1)
    corner = F.struct("place", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    end = F.struct(F.col("size").alias("place"), F.col("hx").cast("double").alias("x"), F.col("hy").cast("double").alias("y"))
    points = F.filter(F.array(F.when(F.col("before").isNull() | (F.col("before") != F.col("d")), corner), F.when(F.col("last"), end)), lambda p: p.isNotNull())
    made = turns.groupBy(OF, "segment", "ring").agg(
        *twins(), F.count("*").alias("steps"), F.transform(F.array_sort(F.flatten(F.collect_list(points))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")
    )
    number = F.row_number().over(Window.partitionBy(OF).orderBy("ring", "segment")) - 1
    sides = [F.col("right").alias("region_right"), F.nullif("left", F.lit(OUTSIDE)).alias("region_left")]
    return made.filter(is_kept()).select(OF, number.alias("number"), F.col("segment").alias("first"), *sides, "points", "steps", "ring")


def face_order(steps: DataFrame, side: int = TILE) -> DataFrame:
    """(image_id, region, segment, forward, x, y, d, cycle, place): borders in order around each region, every outline a cycle.

    Where several of a region's borders leave a node, the one most to the right
    goes on.  (x, y) and d are where and how an outline enters a border;
    ``segment`` is the border's first step in the direction that is kept.  An
    outline begins at its smallest (segment, forward).
    """
    ends = [F.max_by(F.struct("hx", "hy", "d"), "place").alias("end"), F.min_by(F.struct("x", "y", "d"), "place").alias("start")]
    ways = steps.groupBy(OF, "segment", "ring").agg(*twins(), *ends).filter(F.col("right") != OUTSIDE).withColumn("kept", is_kept())
    named = F.when(F.col("kept"), F.col("segment")).otherwise(F.col("twin"))
    node = (named * 2 + F.col("kept").cast("int")).alias("node")
    lines = dealt(ways.select(OF, F.col("right").alias("region"), "start.*", "end", "ring", named.alias("segment"), F.col("kept").alias("forward"), node), "lines")
    open_ = lines.filter("not ring")
    leaving = open_.select(OF, "region", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("d").alias("t_d"), F.col("node").alias("t_node"))
    turn = (F.col("t_d") - F.col("d0") + 4) % 4
    choices = open_.select(OF, "region", "node", "end.hx", "end.hy", F.col("end.d").alias("d0")).join(leaving, [OF, "region", "hx", "hy"])
    rank = F.when(turn == 1, 0).when(turn == 0, 1).when(turn == 3, 2)  # right, ahead, left; never back
    following = choices.withColumn("rank", rank).filter("rank is not null").groupBy(OF, "node").agg(F.min_by("t_node", "rank").alias("next"))
    walked = lines.join(following, [OF, "node"], "left").select(OF, "node", F.when(F.col("ring"), F.col("node")).otherwise(F.col("next")).alias("next"), "region", "segment", "forward", "x", "y", "d")
    return ranked_along(walked, tile_of(F.shiftright("node", 3), side)).select(OF, "region", "segment", "forward", "x", "y", "d", F.col("chain").alias("cycle"), "place")
