"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Rounds


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each end of an edge; a component is named by its smallest node.

    Rounds of two steps over edges (u, v), v < u, each of which ends with
    every node hanging on smaller ones: a node's larger neighbours move to
    the smallest one around it, then its smaller ones do. Each round is a table in the
    shared folder and says itself whether it changed anything: it is the last
    when each node has one edge and no edge's lower end has another below it.
    The rounds grow with the logarithm of the longest chain; a node with
    many neighbours is one row of a minimum taken before the shuffle and one
    side of a join that adaptive execution may split. Nodes may be of any
    type with an order. Edges with a null end and loops are ignored; an empty
    table gives an empty one.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    rounds = Rounds(edges.sparkSession, "edges")
    now = rounds.put(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct().select("u", "v", F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        pairs = now.select("u", "v")
        both = pairs.union(pairs.select("v", "u"))
        # The smallest node around each one, itself included.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"), (F.col("m") < F.col("v")).alias("moved"))
        hung = large.groupBy("u", "v").agg(F.bool_or("moved").alias("moved"))
        lowest = hung.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hung.join(lowest, "u")
        up = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        down = small.where("v = m").select("u", "v", (F.col("moved") | (F.col("n") > 1)).alias("moved"))
        now = rounds.put(up.union(down).groupBy("u", "v").agg(F.bool_or("moved").alias("moved")))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
