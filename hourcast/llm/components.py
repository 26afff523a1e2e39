"""Connected components by alternating star operations on an edge table.

No adjacency list is ever gathered: a round takes each node's smallest
neighbour by a combinable minimum, joins it back to the edges, and hangs
the neighbours onto it. The edge table shrinks towards one star per
component; rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourcast.session import cut_lineage


def _hang(edges: DataFrame) -> DataFrame:
    """(a, b, least b of a)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, component = smallest node) for every node of the long edges
    (a, b); loops and repeated edges do no harm. No edges: no rows."""
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a <> b").distinct())
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark or not new[0]:
            break
        mark = tuple(new)
        # every larger neighbour of u goes to the smallest of u's neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hang(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # u and its smaller neighbours go to the smallest of them
        small = _hang(large)
        now = cut_lineage(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                         F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                          .select("e.a", "e.b").where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
