"""Connected components of a link table, as joins: labels spread and jump until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discarded, written


def tree_edges(members: list[int], fan: int = 8) -> list[tuple[int, int]]:
    """Edges that hold ``members`` together, with few edges at any member and few steps between two."""
    return [(members[(k - 1) // fan], members[k]) for k in range(1, len(members))]


def component_labels(links: DataFrame) -> DataFrame:
    """``links`` (a, b): undirected, any orientation, repeats allowed.

    Returns (node, label) for every node of a link; label is the smallest node
    that can be reached.  Each round a node takes the smallest label among its
    neighbours and then that label's own label, so chains shorten by halves.
    No link or label comes to the driver, only whether a round changed one.  The
    table of a round is deleted once the next one stands.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    before = labels
    while True:
        heard = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        spread = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("next"))
        jumped = spread.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next").select(
            "node", "was", F.least("next", "far").alias("label")
        )
        step = written(jumped, "labels")
        discarded(before)
        before, labels = step, step.select("node", "label")
        if step.filter("was <> label").isEmpty():
            discarded(edges)
            return labels
