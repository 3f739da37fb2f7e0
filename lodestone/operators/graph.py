"""Provenance edges: idempotent adds, degrees, listings, dominance and compaction, version history.

Edges: id, source_id, target_id, kind, origin, confidence (inferred only), created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DEGREE = 10_000


def origin_rank() -> Column:
    return F.when(F.col("origin") == "user_confirmed", 3).when(F.col("origin") == "observed", 2).otherwise(1)


def deduplicated(edges: DataFrame) -> DataFrame:
    """The earliest edge of each (source, target, kind, origin), by time, then id."""
    first = edges.groupBy("source_id", "target_id", "kind", "origin").agg(F.min(F.struct("created_at", "id")).alias("f"))
    return first.select("source_id", "target_id", "kind", "origin", F.col("f.id").alias("id"), F.col("f.created_at").alias("created_at"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each endpoint, in and out, and whether the cap is reached. Partial counts before the exchange."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).withColumn("full", F.col("degree") >= MAX_DEGREE)


def listing(edges: DataFrame, node: str, names: DataFrame, limit: int = 100) -> DataFrame:
    """Edges that touch a node, oldest first, with both ends' names. The bounded page is cut before the joins."""
    page = edges.where((F.col("source_id") == node) | (F.col("target_id") == node)).orderBy("created_at", "id").limit(limit)
    for end in ("source", "target"):
        page = page.join(names.select(F.col("node").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left")
    return page


def dominated(edges: DataFrame) -> DataFrame:
    """Inferred edges with a better edge of the same source, target and kind, and the id of the best one.

    Better: higher origin, then confidence, then earlier, then smaller id; the best tops every chain."""
    w = Window.partitionBy("source_id", "target_id", "kind").orderBy(origin_rank().desc(), F.coalesce("confidence", F.lit(0.0)).desc(), "created_at", "id")
    rows = edges.withColumn("kept_id", F.first("id").over(w))
    return rows.where((F.col("origin") == "inferred") & (F.col("id") != F.col("kept_id"))).select("id", "kept_id")


def compaction(edges: DataFrame, max_removals: int) -> DataFrame:
    """The first max_removals dominated edges by id."""
    return dominated(edges).orderBy("id").limit(max(1, min(max_removals, 10_000)))


def history(versions: DataFrame, limit: int) -> DataFrame:
    """versions: artifact, version, created_at, current. Current first, then newest; `more` tells of a cut."""
    w = Window.partitionBy("artifact").orderBy(F.col("current").desc(), F.col("created_at").desc(), F.col("version").desc())
    rows = versions.withColumn("position", F.row_number().over(w).cast("long"))
    # the row after the page is enough to know that there is more
    rows = rows.withColumn("more", F.lead("version", limit).over(w).isNotNull()).where(F.col("position") <= limit)
    first = F.first("more").over(Window.partitionBy("artifact").orderBy("position"))
    return rows.withColumn("more", first)
