"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.run import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node is connected with.

    ``nodes``: node; ``edges``: a, b in any direction, repeated or not; loops do nothing. Large-star and small-star
    steps alternate until no edge changes (Kiveris et al. 2014): a logarithmic number of rounds, no neighbourhood
    is gathered into one task, since each step only takes minima. Each round is cut by a checkpoint, so that lost
    executors cost one round. Nodes without an edge are their own root; edges of unknown nodes are ignored.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        around = both(now)
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    root = now.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.select("node").distinct().join(root, nodes["node"] == root["a"], "left").select("node", F.coalesce("root", "node").alias("root"))
