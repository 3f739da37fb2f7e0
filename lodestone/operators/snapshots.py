"""Stored snapshots of (key, hash) tables that are compared by a tree of digests.

A row belongs to a leaf by the first DEPTH hex digits of its key's SHA-256; every shorter prefix is an inner node. A node's digest is
a count with, for four lanes of its rows' SHA-256, an exclusive or and an exact sum, so it is added up from partial digests in any order, and equal
rows do not cancel. Rows stand in folders by their first digits. A comparison goes down both trees from the root and reads a
level only below nodes that differ, and rows only from folders and leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a leaf and of a folder: 4,096 leaves in 16 folders. Larger tables take a deeper tree.
DEPTH, FOLDER = 3, 1
LANES = 4
STORED = "key string, hash string, leaf string, folder string"


def _lane(i: int) -> Column:
    return F.conv(F.substring("row", 1 + 15 * i, 15), 16, 10).cast("long")


def _digest(parts: bool) -> list[Column]:
    """Aggregates of rows (parts false) or of nodes below (true)."""
    count = F.sum("n") if parts else F.count("*")
    value = lambda kind, i: F.col(f"{kind}{i}") if parts else _lane(i)
    return [count.alias("n"), *(F.bit_xor(value("x", i)).alias(f"x{i}") for i in range(LANES)), *(F.sum(value("s", i).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in range(LANES))]


def write_snapshot(rows: DataFrame, path: str, depth: int = DEPTH) -> None:
    """rows: key (string), hash (string), keys distinct. Writes rows and the nodes of every level."""
    named = rows.select("key", "hash", F.substring(F.sha2("key", 256), 1, depth).alias("leaf"), F.sha2(F.concat_ws("\x00", "key", "hash"), 256).alias("row"))
    named.withColumn("folder", F.substring("leaf", 1, FOLDER)).repartition("folder").sortWithinPartitions("folder", "leaf", "key").write.partitionBy("folder").parquet(f"{path}/rows")
    spark = rows.sparkSession
    stored = spark.read.schema(STORED).parquet(f"{path}/rows").withColumn("row", F.sha2(F.concat_ws("\x00", "key", "hash"), 256))
    level = stored.groupBy(F.col("leaf").alias("node")).agg(*_digest(False))
    for d in range(depth, -1, -1):
        level.write.parquet(f"{path}/level={d}")
        level = spark.read.schema(level.schema).parquet(f"{path}/level={d}").groupBy(F.substring("node", 1, d - 1).alias("node") if d > 1 else F.lit("").alias("node")).agg(*_digest(True))


def _differing(spark: SparkSession, a: str, b: str, level: int, parents: DataFrame | None) -> DataFrame:
    """Nodes of one level, below nodes that differ, whose digests differ or that one side lacks."""

    def nodes(path: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/level={level}")
        digest = F.struct(*(c for c in df.columns if c != "node"))
        df = df.select("node", digest.alias("digest"))
        return df if level < 2 else df.join(parents, F.substring("node", 1, level - 1) == F.col("parent"), "left_semi")

    one, two = nodes(a).withColumnRenamed("digest", "one"), nodes(b).withColumnRenamed("digest", "two")
    return one.join(two, "node", "full_outer").where(~F.col("one").eqNullSafe(F.col("two"))).select("node")


def differences(spark: SparkSession, before: str, after: str, depth: int = DEPTH) -> DataFrame:
    """key and why (added, removed, changed) of what differs between two snapshots of one depth.

    The driver holds the differing folders (16); other nodes stay tables."""
    kind = "key string, why string, before string, after string"
    parents = None
    for level in range(depth + 1):
        found = _differing(spark, before, after, level, parents)
        if level == FOLDER:
            folders = [r[0] for r in found.collect()]
            if not folders:
                return spark.createDataFrame([], kind)
            found = spark.createDataFrame([(f,) for f in folders], "node string")
        elif level == 0 and found.isEmpty():
            return spark.createDataFrame([], kind)
        parents = found.withColumnRenamed("node", "parent")
    leaves = parents.withColumnRenamed("parent", "leaf")
    read = lambda path: spark.read.schema(STORED).parquet(f"{path}/rows").where(F.col("folder").isin(folders)).join(leaves, "leaf", "left_semi")
    one, two = read(before).select("key", F.col("hash").alias("before")), read(after).select("key", F.col("hash").alias("after"))
    why = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return one.join(two, "key", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("key", why.alias("why"), "before", "after")
