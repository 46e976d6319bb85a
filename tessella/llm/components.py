"""Connected components of an edge table, all on the executors.

Each round hooks every node to its smallest neighbour, halves the paths by two
pointer jumps and contracts the edges onto the new roots.  The graph shrinks
geometrically; each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, settled


def _jump(parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("node").alias("via"), F.col("root").alias("next"))
    return parent.join(up, parent.root == up.via).select("node", F.col("next").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable ids -> ``(node, root)`` for every node of an edge.

    ``root`` is the smallest id of the component.  Null ends, loops and
    repeated edges are ignored; an empty table gives an empty one.
    """
    return settled(lambda: _rounds(edges), "components")


def _rounds(edges: DataFrame) -> DataFrame:
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    found = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parent = ends.groupBy("node").agg(F.min("other").alias("root"))
        parent = materialise(parent.select("node", F.least("node", "root").alias("root")), "hooks")
        if found is not None and parent.isEmpty():
            return found
        parent = materialise(_jump(_jump(parent)), "roots")
        left, right = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        edges = materialise(
            edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
        if found is None:
            found = parent
        else:
            found = found.join(parent.toDF("root", "further"), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        if edges.isEmpty():
            return found
