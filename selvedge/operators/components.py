"""Connected components by alternating large-star and small-star rounds.

Edges never leave the executors; each round is two aggregations and two joins
of the remaining edges, written to the shared folder, and the number of rounds
grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.session import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges; component is its smallest node.

    Null ends, loops and repeated edges are ignored, except that a node with
    only a loop is its own component. An empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    stars = materialize(pairs.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = stars.unionAll(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        before, stars = stars, materialize(small.distinct())
        discard(before)
    return nodes.join(stars, nodes.node == stars.u, "left").select("node", F.coalesce("v", "node").alias("component"))
