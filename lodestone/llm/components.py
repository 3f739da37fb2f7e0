"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """large: every larger neighbour of a node is tied to the node's smallest neighbour (or itself);
    small: the node and its smaller neighbours are tied to the smallest. Also the written table that the links are read from."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = common.staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = common.staged(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct(), least


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges: a, b (long). One row per node that has an edge: id, root (the smallest id it reaches).

    Both steps aggregate with partial sums and write what they join with, so the join reads plain exchanges
    and a hub is split by adaptive skew handling; rounds grow with the logarithm of the longest chain. Nothing reaches the driver but
    a count and a checksum a round. No edges: an empty table."""
    edges = common.staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most):
        tied, large = _star(edges, True)
        tied, small = _star(tied, False)
        last, edges = edges, common.staged(tied, "edges")
        common.discard(last, large, small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components are unfinished after {most} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
