"""Connected components of a graph in DataFrames: hooking to the smallest neighbour, then contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of the edges (a, b); nodes of a component share its label.

    Each round replaces a label by the smallest label next to it (two steps at once) and contracts the edges; the number of
    labels that still have an edge at least halves. The steps are put together at the end. Tables are written between rounds, so
    no lineage grows; those of past rounds are deleted.
    """
    own = Scratch(scratch.spark)
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    live = own.write(live, "edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        up = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hook = own.write(near.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "hooks")
        steps.append(hook)
        ends = live.join(hook, "a").select(F.col("p").alias("x"), F.col("b").alias("a")).join(hook, "a").select("x", F.col("p").alias("y"))
        live = own.write(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        own.clear(live, *steps)
    if not steps:
        own.clear()
        return scratch.spark.createDataFrame([], "node long, label long")
    labels = steps[0].select(F.col("a").alias("node"), F.col("p").alias("label"))
    for step in steps[1:]:
        labels = labels.join(step.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    labels = own.write(labels, "labels")
    own.clear(labels)
    scratch.paths |= own.paths
    return labels
