"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inlay.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the ends of ``edges(a, b)``; a label is the smallest node of its component.

    Each round every node points to its smallest neighbour (or itself), the pointers are
    followed to their roots by doubling, and the edges are carried over to the roots.
    Every root that has edges is joined to another, so rounds grow with the logarithm of
    the nodes.  Only counts come to the driver; each step is a stored table.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().selectExpr("node", "node label"), "labels")
    while edges.take(1):
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        nearest = both.groupBy("a").agg(F.min("b").alias("least"))
        parent = materialize(nearest.selectExpr("a node", "least(a, least) root"), "roots")
        while True:
            above = parent.selectExpr("node root", "root upper")
            moved = materialize(parent.join(above, "root").selectExpr("node", "upper root", "upper != root moved"), "roots")
            parent = moved.select("node", "root")
            if not moved.where("moved").take(1):
                break
        to = parent.withColumnRenamed("node", "label")
        step = labels.join(to, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        labels = materialize(step, "labels")
        ends = edges.join(parent.selectExpr("node a", "root ra"), "a").join(parent.selectExpr("node b", "root rb"), "b")
        edges = materialize(ends.where("ra != rb").selectExpr("ra a", "rb b").distinct(), "edges")
    return labels
