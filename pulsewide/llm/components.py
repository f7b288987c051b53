"""Connected components of an edge table, by large and small stars.

A star's middle may have a third of all edges: its smallest neighbour is found with a
map-side step, and goes to the edges by a salted join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewide.operators.salting import join_distinct
from pulsewide.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return join_distinct(both, least, "u", "inner").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_distinct(down, least, "u", "inner").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node ``u`` or ``v`` that is not its component's
    smallest. Each round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. Nothing but counts comes to the driver."""
    current = edges.where(F.col("u") != F.col("v")).select("u", "v")
    mark = None
    while True:
        current = materialise(_small_star(_large_star(current)).distinct())
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(now)
