"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(edges: DataFrame) -> DataFrame:
    """u and the least of its neighbours v and itself. Partial sums meet each key, so a hub costs no more than others."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node it is linked to) of every node that has an edge to another node.

    Each step is a grouping and a join, written to the shared folder; the number of steps grows with the logarithm of
    the longest path. Edges with null ends and loops are left out; repeated and reversed edges do no harm.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = written(now, "components")
    state = None
    while True:
        # large star: every neighbour above a node moves to the node's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its neighbours below move to the least of them
        large = written(large.distinct(), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "components")
        # two moments of a hash of the edges: equal only if nothing changed
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        row = now.agg(F.count(F.lit(1)), F.sum(mark), F.sum(F.abs(mark))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
