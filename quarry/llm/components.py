"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.materialize import as_leaf, drop_leaf


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node in `links` (a, b); label is the smallest node it is connected to.

    A round gives each node the smallest of itself and its neighbours, follows that once more, and puts
    the links' ends in terms of it; links within a label go. The graph that is left shrinks with each round,
    and the rounds' maps are composed. Nothing but counts reaches the driver.
    """
    edges = as_leaf(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        near = as_leaf(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        far = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = as_leaf(near.join(far, "to", "left").select("node", F.coalesce("next", "to").alias("label")))
        end = lambda c: step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        moved = edges.join(end("a"), "a").join(end("b"), "b").select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
        left = as_leaf(moved.where("a <> b").distinct())
        drop_leaf(edges, near)
        edges = left
        if labels is None:
            labels = step
        else:
            over = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            longer = as_leaf(labels.join(over, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
            drop_leaf(labels, step)
            labels = longer
    drop_leaf(edges)
    return labels if labels is not None else links.sparkSession.createDataFrame([], "node long, label long")
