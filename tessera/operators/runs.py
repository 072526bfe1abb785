"""Runs instead of pixels: maximal stretches of a line with one value, and how runs of neighbouring lines meet.

Every step is a window over one line or over two, so that work and memory follow
a line's width; an image's lines spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graphs import OF, components
from tessera.sources.scratch import dealt

#: A run is named by its first pixel: line * STRIDE + column, so that names ascend in raster order.
STRIDE = 1 << 31


def pixel_name(y: str = "y", x: str = "x"):
    return F.col(y).cast("long") * STRIDE + F.col(x)


def row_runs(cells: DataFrame, value: str) -> DataFrame:
    """(image_id, y, x0, x1, value, node) of cells(image_id, x, y, value): gaps and islands along each line."""
    line = Window.partitionBy(OF, "y").orderBy("x")
    goes_on = (F.lag("x").over(line) == F.col("x") - 1) & (F.lag(value).over(line) == F.col(value))
    turned = cells.select(OF, "x", "y", F.col(value).alias("value"), F.when(goes_on, 0).otherwise(1).alias("turn"))
    run = turned.withColumn("run", F.sum("turn").over(line)).groupBy(OF, "y", "run")
    return run.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("value").alias("value")).select(OF, "y", "x0", "x1", "value", pixel_name("y", "x0").alias("node"))


def meeting(runs: DataFrame, diagonal: bool = False, same: bool = True) -> DataFrame:
    """(image_id, a, b, shared): runs ``a`` of a line and ``b`` of the next that meet, of equal values if ``same``.

    Of two runs that meet, the one that begins later begins within the other; so
    each run looks only at the last one of the other line that begins before it.
    ``shared`` is how many columns both have.  Diagonally, runs are half a pixel
    longer at both ends.
    """
    if diagonal and not same:
        raise ValueError("runs that touch in their line have no single neighbour across a corner")
    more = 1 if diagonal else 0
    run = F.struct("x0", "x1", "value", "node")
    seen = [
        runs.select(OF, (F.col("y") + 1).alias("y"), F.lit(0).alias("side"), (F.col("x0") * 2 - more).alias("s"), (F.col("x1") * 2 + more).alias("e"), run.alias("run")),
        runs.select(OF, "y", F.lit(1).alias("side"), (F.col("x0") * 2 - more).alias("s"), (F.col("x1") * 2 + more).alias("e"), run.alias("run")),
    ]
    before = Window.partitionBy(OF, "y", *(["run.value"] if same else [])).orderBy("s", "side").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("e", "run")
    last = [F.last(F.when(F.col("side") == k, own), ignorenulls=True).over(before) for k in (0, 1)]
    other = F.when(F.col("side") == 0, last[1]).otherwise(last[0])
    met = seen[0].unionByName(seen[1]).withColumn("other", other).filter(F.col("other.e") >= F.col("s"))
    upper, lower = F.when(F.col("side") == 0, F.col("run")).otherwise(F.col("other.run")), F.when(F.col("side") == 0, F.col("other.run")).otherwise(F.col("run"))
    shared = F.least("run.x1", "other.run.x1") - F.greatest("run.x0", "other.run.x0") + 1
    return met.select(OF, upper["node"].alias("a"), lower["node"].alias("b"), upper["value"].alias("a_value"), lower["value"].alias("b_value"), shared.alias("shared"))


def labelled_runs(cells: DataFrame, value: str, diagonal: bool = False) -> DataFrame:
    """(image_id, y, x0, x1, value, node, label): runs with the first pixel, in raster order, of their connected piece of equal value."""
    runs = dealt(row_runs(cells, value), "runs")
    labels = components(meeting(runs, diagonal))
    return runs.join(labels, [OF, "node"], "left").select(OF, "y", "x0", "x1", "value", "node", F.coalesce("label", "node").alias("label"))


def numbered(runs: DataFrame) -> DataFrame:
    """``runs`` with ``component``: pieces numbered from 1 in raster order of their first pixels."""
    order = Window.partitionBy(OF).orderBy("label")
    firsts = runs.filter("node = label").select(OF, "label", F.row_number().over(order).alias("component"))
    return runs.join(firsts.hint("merge"), [OF, "label"])


def run_boxes(runs: DataFrame) -> DataFrame:
    """(image_id, component, area, left, top, right, bottom) of numbered runs."""
    return runs.groupBy(OF, "component").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("left"), F.min("y").alias("top"), (F.max("x1") + 1).alias("right"), (F.max("y") + 1).alias("bottom")
    )


def run_cells(runs: DataFrame, *columns: str) -> DataFrame:
    """The pixels (image_id, x, y) of runs, with some of their columns."""
    return runs.select(OF, *columns, F.explode(F.sequence("x0", "x1")).alias("x"), "y")
