"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _signature(edges: DataFrame) -> tuple[int, int, int]:
    """Count and two sums over the edges' hashes: equal for equal sets of edges, and else as good as never."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("y")).first()
    return row.n, row.x or 0, row.y or 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every
    round links neighbours to the smallest one they know, so that a component
    becomes a star in a logarithmic number of rounds. Minima are aggregated
    before the shuffle; the join that hands them back can be split by Spark
    where one node has very many neighbours. Each round is checkpointed.
    Null ends and self links are left out; no edges give an empty result.
    """
    known = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    known = cut_lineage(known)
    before = _signature(known)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the node's minimum
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut_lineage(small.where("u != v").distinct())
        known, now = after, _signature(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = known.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
