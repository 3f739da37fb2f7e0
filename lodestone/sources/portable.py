"""Portable export and import: tables as JSON lines in key order with a manifest of counts and digests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.records import digest_tree

FORMAT, VERSION = "lodestone.portable", 1


class ImportRefused(ValueError):
    """An export that is damaged, of another version, or does not fit the tables."""


@dataclass(frozen=True)
class Table:
    """Schema (DDL), key column (long), and references: column to (table, its key)."""

    schema: str
    key: str
    references: tuple[tuple[str, str], ...] = ()


def _row_digest(df: DataFrame, key: str) -> DataFrame:
    columns = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return digest_tree(df.select(F.col(key).alias("k"), row.alias("h")), "k", "h")


def export(tables: dict[str, DataFrame], layout: dict[str, Table], path: str) -> None:
    """Write every table and, last, the manifest; without it an export is not there."""
    spark = next(iter(tables.values())).sparkSession
    manifest = []
    for name, t in layout.items():
        df = tables[name]
        df.repartitionByRange(t.key).sortWithinPartitions(t.key).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
        digest = _row_digest(df, t.key).first()
        manifest.append((FORMAT, VERSION, name, df.count(), digest["digest"] if digest else None))
    spark.createDataFrame(manifest, "format string, version int, name string, n long, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read(spark: SparkSession, layout: dict[str, Table], path: str) -> dict[str, DataFrame]:
    """The tables of an export after all checks: format, version, tables, columns, keys, counts, digests, references."""
    try:
        manifest = {r["name"]: r for r in spark.read.schema("format string, version int, name string, n long, digest string").json(f"{path}/manifest").collect()}
    except Exception as error:
        raise ImportRefused("no manifest") from error
    if any((r["format"], r["version"]) != (FORMAT, VERSION) for r in manifest.values()) or manifest.keys() != layout.keys():
        raise ImportRefused("format, version or tables differ")
    out = {}
    for name, t in layout.items():
        raw = spark.read.text(f"{path}/{name}")
        wanted = {f.split()[0] for f in t.schema.split(", ")}
        other = raw.select(F.explode(F.coalesce(F.json_object_keys("value"), F.array(F.lit("")))).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
        n = manifest[name]["n"]
        if {r["c"] for r in other} != (wanted if n else set()) or any(r["n"] != n for r in other):
            raise ImportRefused(f"{name}: columns or number of rows differ")
        df = spark.read.schema(t.schema).option("mode", "FAILFAST").json(f"{path}/{name}")
        digest = _row_digest(df, t.key).first()
        if df.select(t.key).distinct().count() != n or (digest["digest"] if digest else None) != manifest[name]["digest"]:
            raise ImportRefused(f"{name}: keys repeat or the digest differs")
        out[name] = df
    for name, t in layout.items():
        for column, parent in t.references:
            keys = out[parent].select(F.col(layout[parent].key).alias(column))
            if not out[name].where(F.col(column).isNotNull()).join(keys, column, "left_anti").isEmpty():
                raise ImportRefused(f"{name}.{column}: rows without their {parent}")
    return out
