"""Connected components of links between 64-bit nodes, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablejobs.session import materialize


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``least`` (the lowest node of its component) for all nodes of
    ``links`` (columns a, b).

    Each round hangs all neighbours of a node on its lowest neighbour: first
    those that are higher, then those that are lower. The number of rounds grows
    with the logarithm of a component's size; a round's rows never outnumber the
    links. Every round is written, so a lost executor repeats one at most. A
    node with very many neighbours is reduced to minima before the shuffle.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(both, "links"), None
    while True:
        lower = edges.groupBy("a").agg(F.min("b").alias("m"))
        # Higher neighbours hang on the lowest of all neighbours and the node.
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = (around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = (edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        large = materialize(large.distinct(), "large")
        # Lower neighbours, and the node itself, hang on the lowest of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = materialize(small, "small")
        # Sums over all edges stay the same once nothing moves.
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("least"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(tops)
