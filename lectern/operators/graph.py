"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage


def flattened(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` to the roots; every step doubles the distance covered."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        longer = cut_lineage(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("top", "parent").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")
            ),
            "parents",
        )
        parents = longer.select("node", "parent")
        if longer.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` of every node of the edges: the smallest node it is connected with.

    Every round hooks each node to its smallest neighbour, flattens the trees and keeps the edges between trees.
    Of the trees that still touch another at most half remain, so the rounds are logarithmic in the nodes, whatever
    the shape: a chain of a million links takes about twenty.
    """
    pairs = cut_lineage(
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct(), "edges"
    )
    found = None
    while found is None or not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parents = flattened(cut_lineage(hooked.select("node", F.least("node", "low").alias("parent")), "parents"))
        if found is None:
            found = parents
        else:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            joined = found.join(up, "parent", "left")
            found = cut_lineage(joined.select("node", F.coalesce("top", "parent").alias("parent")), "members")
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        ends = pairs.join(left, "a").join(right, "b").filter("pa != pb")
        pairs = cut_lineage(
            ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges"
        )
    return found.select("node", F.col("parent").alias("component"))
