"""Connected components by least labels, as joins of tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored


def roots(parents: DataFrame) -> DataFrame:
    """node, component for every node of a forest of edges (node, parent), at most one a node: the root that parents lead to, itself included.

    Each round a node skips to its parent's parent, so a path of length n takes about log n rounds and a star one. Rows of a
    round are the nodes that have a parent; a parent of very many is met by a join that can be split.
    """
    now = stored(parents.select("node", "parent"), "graph-parents")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        near = stored(now.join(maybe_broadcast(up, 24), "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")), "graph-parents")
        now = near.select("node", "parent")
        if near.where("moved").isEmpty():
            every = now.unionByName(now.select(F.col("parent").alias("node"), "parent").distinct())
            return stored(every.select("node", F.col("parent").alias("component")), "graph-labels")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) for every node of edges (a, b); direction and repetition are of no matter.

    In each round a node takes the least label of its neighbours and then the label of that label, so a chain of length n takes
    about log n rounds and a star two. A node with very many neighbours is met by partial minima and by joins that can be split.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "graph-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("node"), "component"), "graph-labels")
    rows = labels.count()
    while True:
        least = both.join(maybe_broadcast(labels.select(F.col("node").alias("b"), "component"), 24, rows), "b").groupBy("a").agg(F.min("component").alias("near"))
        near = stored(labels.join(least.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "graph-near")
        up = maybe_broadcast(near.select(F.col("node").alias("component"), F.col("component").alias("up")), 24, rows)
        jumped = stored(near.join(up, "component", "left").select("node", "old", F.least("component", "up").alias("component")), "graph-labels")
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels
