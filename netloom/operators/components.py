"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.storage import Store


def component_labels(edges: DataFrame, store: Store) -> DataFrame:
    """``edges`` (a, b) to (node, label): each node of an edge with the smallest node that it reaches.

    Every round points each node at its smallest neighbour, follows the pointer once more and draws the edges anew
    between what they lead to; at least every second node of an edge is gone after a round. Neighbours are never
    gathered, only their smallest is kept, so a node with very many edges is no large group.
    """
    edges = store.put(edges.where("a <> b").distinct())
    labels = store.put(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy(F.col("a").alias("from")).agg(F.least("a", F.min("b")).alias("to"))
        nxt = to.select(F.col("from").alias("at"), F.col("to").alias("then"))
        to = store.put(to.join(nxt, F.col("to") == F.col("at"), "left").select("from", F.coalesce("then", "to").alias("to")))
        old, old_labels = edges, labels
        a, b = to.select(F.col("from").alias("a"), F.col("to").alias("x")), to.select(F.col("from").alias("b"), F.col("to").alias("y"))
        edges = store.put(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = store.put(labels.join(to, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label")))
        store.free(old, old_labels, to)
    return labels
