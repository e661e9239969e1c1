"""Connected components by alternating large-star and small-star steps.

Every step sends one row per edge through one aggregation with map-side partials, whose result is dealt anew,
and one equi-join with it that adaptive execution can split, so a hub with most of the edges is no single
task.  The number of rounds grows with the logarithm of the number of nodes; they end when all edges lead
straight to a least node.  A round writes two tables, and nothing is collected but two
numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.plans.staging import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch | None = None) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # a struct as the key: the aggregate is exchanged right below the join, so that a skewed node is split
    joined = both.withColumn("k", F.struct("u")).join(least.select(F.struct("u").alias("k"), "m"), "k")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))  # a row for each edge
    return joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b")).distinct()


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes have edges to two smaller ones, or to a smaller one and from a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(sums.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """``edges(a, b)`` of one orderable type → ``(node, root)``, root the least node reachable.

    Self loops and repeated edges count for nothing; edges with a null end are ignored; a node without
    an edge to another is not in the result; no edges give an empty table.  The result reads a staged table,
    which goes with ``scratch`` where one is given.
    """
    spark = edges.sparkSession
    with Scratch(spark) as own:
        # held as a > b: every node points to a smaller one
        now = own.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where(edges.a.isNotNull() & edges.b.isNotNull() & (edges.a != edges.b))
                        .distinct(), "edges")
        for _ in range(max_rounds):
            rows, left = _unsettled(now)
            if not left:
                break
            large = own.stage(_star(now, True), "large", rows)
            now = own.stage(_star(large, False), "edges", 2 * rows)
            own.forget(last=False)
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        path = own.paths.pop()  # the result reads it
        if scratch is not None:
            scratch.paths.append(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
