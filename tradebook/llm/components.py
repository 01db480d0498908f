"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.session import pinned


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest node reachable.

    Each round points every node's larger neighbours at its smallest one, then its smaller ones
    (large star, small star); the edges are written to the shared folder once a round, so no lineage
    grows and a lost executor costs one round. The number of rounds grows with the logarithm of the
    longest path. Self-loops and repeated edges do no harm.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct()
    now, before = pinned(both), None
    while True:
        stars = both_ways(now).groupBy("u").agg(F.min("v").alias("low"))
        large = (
            both_ways(now).join(stars, "u").where("v > u")
            .select(F.col("v").alias("a"), F.least("u", "low").alias("b"))
        )
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
        lows = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(lows, "u")
        now = pinned(
            small.select(F.col("v").alias("a"), F.col("low").alias("b")).where("a <> b")
            .union(lows.select(F.col("u").alias("a"), F.col("low").alias("b"))).distinct()
        )
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
