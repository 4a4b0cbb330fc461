"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.storage import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of edges (a, b). Each round maps every node to the smallest of itself and
    its neighbours and contracts the edges, so rounds grow with the logarithm of a component's size; what is left
    of the edges, and the labels, are tables in the shared folder."""
    labels = None
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to")), "contraction")
        edges = materialise(
            edges.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(to.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = materialise(labels, "labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
