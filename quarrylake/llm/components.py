"""Connected components over a link table, by alternating star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` but the roots; root is the least node reachable.

    Each round attaches a node's larger neighbours to its least neighbour (large star), then
    its smaller neighbours to the least of them (small star); the number of rounds grows with
    the logarithm of the longest chain. Every join meets one row a node, the minima are
    pre-aggregated before their shuffle, and adaptive execution splits the link side of a
    node with very many links. Each round is written to the shared folder. An empty link table gives an empty result.
    """
    edges = scratch.keep(links.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct()
        )
        after = scratch.keep(small)
        mark = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        same = mark(edges) == mark(after)
        scratch.drop(edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
