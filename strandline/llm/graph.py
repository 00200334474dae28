"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a join or an aggregate on node keys; edges stay distributed, and each round is written to
the shared folder. Large-star links a node's larger neighbours to its smallest one, small-star its smaller
ones; the edges end as stars around the smallest node of each component, in O(log**2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_saved, free_shuffles, save


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (a, b) of any one orderable type. Gives (node, root) for each node but the roots themselves."""
    stars = save(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(most_rounds):
        # Large-star: among u's neighbours and u the smallest is m; each neighbour above u is linked to m.
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small-star: u and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        after = save(small)
        # At the fixed point every node has one smaller neighbour, and no root has any.
        done = after.groupBy("hi").count().where("count > 1").isEmpty() and after.join(after.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()
        drop_saved(stars)
        stars = after
        free_shuffles(edges.sparkSession)
        if done:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
