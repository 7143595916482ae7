"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them; a > b in each edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return (
        linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .filter("a <> b")
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node it can reach.

    edges: columns a, b of one orderable type. Loops, repeated edges and edges in either
    direction are fine; rows with a null are ignored; no edges give no rows. Nothing but
    three numbers a round reaches the driver; each round is checkpointed, and stars need
    about log2 of the longest chain in rounds.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = checkpointed(now), None
    for _ in range(max_rounds):
        # One row: all edges point at roots when nothing changes any more. Edges are distinct, so hashes can be folded by xor.
        folded = (F.bit_xor(F.xxhash64(F.lit(seed), "a", "b")) for seed in (1, 2))
        state = tuple(now.agg(F.count("*"), *folded).first())
        if state[0] == 0 or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        now, before = checkpointed(_small_star(_large_star(now))), state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
