"""Connected components of a link table, by alternating star operations on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.session import written


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join's two sides are dealt alike and Spark can split a node with many links
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = written(links.groupBy("b").agg(F.min("a").alias("m")))
    others = links.join(least, "b").where(F.col("a") > F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.union(least.select(F.col("m").alias("a"), "b")).distinct()


def labels(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node it reaches.

    Each round at least halves the distance to the root, so the number of rounds grows with the
    logarithm of the longest path.  Links of a node to itself and repeated links change nothing.
    """
    now = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        now = written(_small(written(_large(now))))
        # stars: every larger end has one link, and no root is itself a larger end
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
