"""Checks and counts of canonical records: reconcile, evidence checks, purge counts, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored artifacts that a complete scan did not see."""
    return stored.join(seen.select("artifact_id"), "artifact_id", "left_anti").withColumn("state", F.lit("missing"))


def verified(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requests (passage_id, content_hash, text_hash) whose whole tuple is current."""
    return requests.join(current, ["passage_id", "content_hash", "text_hash"], "left_semi")


def stale(requests: DataFrame, current: DataFrame) -> DataFrame:
    return requests.join(current, ["passage_id", "content_hash", "text_hash"], "left_anti")


def purge_counts(gone: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """gone: artifact_id. Rows that go from each child table: those whose key columns hold a purged artifact."""
    out = gone.agg(F.count("*").alias("n")).select(F.lit("artifacts").alias("relation"), "n")
    for name, (rows, keys) in children.items():
        if len(keys) == 1:
            hit = rows.join(gone.withColumnRenamed("artifact_id", keys[0]), keys[0], "left_semi")
        else:  # either end: one row an edge, however many ends are purged
            ids = gone.select("artifact_id").withColumn("hit", F.lit(1))
            hit = rows
            for k in keys:
                hit = hit.join(ids.select(F.col("artifact_id").alias(k), F.col("hit").alias(f"hit_{k}")), k, "left")
            hit = hit.where(" or ".join(f"hit_{k} = 1" for k in keys))
        out = out.union(hit.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n"))
    return out


def digest_tree(rows: DataFrame, id_col: str, row_hash: str, fan_out: int = 1000, levels: int = 4) -> DataFrame:
    """One digest of a table in id order: blocks of ids, then blocks of blocks, so no task holds more than fan_out hashes a group."""
    level = rows.select(F.col(id_col).alias("i"), F.col(row_hash).alias("h"))
    for _ in range(levels):
        parts = level.groupBy(F.floor(F.col("i") / fan_out).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
        level = parts.select("i", F.sha2(F.array_join(F.transform("x", lambda s: s["h"]), "|"), 256).alias("h"))
    return level.groupBy().agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda s: s["h"]), "|"), 256).alias("digest"))
