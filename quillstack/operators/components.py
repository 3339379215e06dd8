"""Connected components of an edge table, by alternating star contraction.

Every round does two things to the edges (larger, smaller): *large star* links
each node's larger neighbours to its smallest neighbour, *small star* links its
smaller neighbours and itself to it.  The edges end as stars around each
component's smallest node, after a number of rounds that grows with the
logarithm of the longest path.  Each round is two grouped minima and joins on
node keys, written to the shared folder, so that a lost executor costs one round
at most; nothing is gathered on the driver but one answer per round: whether stars are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, release


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) with a > b; the next edges, of the same form, and the table of minima they read.

    The minima are written before they are joined, so that the join stands
    directly on its exchanges and AQE can split a node that very many edges have.
    """
    if large:
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    low = durable(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
    joined = both.join(low, "n")
    if large:
        out = joined.filter("m > n").select(F.col("m").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
    return out.filter("a != b").distinct(), low


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each larger node has one smaller one, which has none itself."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node it reaches.

    Nodes may be of any orderable type.  Loops, repeated edges and edges in both
    directions are fine; an edge with a null end links nothing.  An empty table
    gives no rows.
    """
    loose = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x is not null and y is not null")
    current = durable(loose.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    for _ in range(max_rounds):
        if _settled(current):
            break
        stars, low = _star(current, large=True)
        stars = durable(stars)
        release(low)
        following, low = _star(stars, large=False)
        following = durable(following)
        release(low, stars, current)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
