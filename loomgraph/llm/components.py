"""Connected components of a distributed edge table, by alternating star contractions.

Large-star joins every neighbour of a node that is larger than it to the least of its
neighbourhood, small-star does so with the smaller ones; the edges become stars around the
components' least nodes in a number of rounds that grows with the logarithm of a component's
size. Each round is two aggregations of minima, which combine before the shuffle, and two
joins on the node, whose hot keys adaptive execution can split; its edges are written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, stash

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges has (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        # v's larger neighbours u go to the least around v
        moved = edges.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = edges.join(least, F.col("u") == F.col("n"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node it can reach. No row reaches the driver but counts. at_most: how many edges there may be, if known."""
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    with Steps(edges.sparkSession) as steps:
        e = steps.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", at_most)
        for _ in range(MAX_ROUNDS):
            n, print_ = e.agg(F.count(F.lit(1)), mark).first()
            if not n or (n, print_) == before:
                break
            before = (n, print_)
            e = steps.written(_star(_star(e, large=True), large=False), "edges", at_most=2 * n)  # a step makes two edges of one at most
        else:
            raise RuntimeError("components did not settle")
        return stash(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots", at_most=2 * (before or (0,))[0])
