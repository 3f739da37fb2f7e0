"""The canonical tables of evidence retrieval, made from the driver's tables.

documents give artifacts, one version each, and passages; what the driver's tables lack is set by plain rules
(title, media type and address from id, language and source; modification time from the id; one source
is a revoked root). These rules are stand-ins for testing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import splitting
from lodestone.functions import text as T

REVOKED = "src7"
EPOCH_NS, HOUR_NS = 1_704_067_200_000_000_000, 3_600_000_000_000
#: Times in nanoseconds; 64 bits end in the year 2262, which artifact 2,088,696 is past.
TIME = "decimal(38,0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores (a small file) dealt over all cores by its first column, the key; larger tables stay as they are.
    Dealt in turn, Spark would sort each file's part first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, title, media_type, source_uri, root, enabled, mtime_ns, content_hash, byte_size, text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    markdown = F.col("lang") == "en"
    title = F.concat(F.lit("doc-"), F.col("doc_id"), F.when(markdown, ".md").otherwise(".txt"))
    text = T.normalized_lines(F.col("text"))
    return d.select(
        F.col("doc_id").alias("artifact_id"), title.alias("title"), F.when(markdown, "text/markdown").otherwise("text/plain").alias("media_type"),
        F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), title).alias("source_uri"), F.col("source").alias("root"), (F.col("source") != REVOKED).alias("enabled"),
        (F.lit(EPOCH_NS) + F.col("doc_id").cast("decimal(20,0)") * HOUR_NS).cast(TIME).alias("mtime_ns"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_size"), text.alias("text"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with its artifact: passage_id, rowid, ordinal, char_start, char_end, lines, passage_text and artifact columns."""
    a = artifacts(spark, sf_dir)
    p = a.withColumn("p", F.explode(splitting.split_passages(F.col("text"))))
    return p.select(
        F.concat_ws(":", "artifact_id", "p.ordinal").alias("passage_id"), (F.col("artifact_id") * 1_000_000 + F.col("p.ordinal")).alias("rowid"),
        "artifact_id", F.col("p.ordinal").cast("long").alias("ordinal"), F.col("p.char_start").cast("long").alias("char_start"), F.col("p.char_end").cast("long").alias("char_end"), F.col("p.line_start").cast("long").alias("passage_line"), F.col("p.line_end").cast("long").alias("passage_last_line"), F.col("p.text").alias("passage_text"),
        "title", "media_type", "source_uri", "root", "enabled", "mtime_ns", "content_hash", "text",
    )


def active(df: DataFrame) -> DataFrame:
    """Rows of roots that are enabled."""
    return df.where("enabled")


# The same tables in DuckDB SQL: texts of WITH clauses.

_END = "CASE WHEN {s} + 1000 >= n THEN n WHEN length(regexp_extract(substr(text, {s} + 601, 400), '(?s)^(.*\\s)', 1)) > 0 THEN {s} + 600 + length(regexp_extract(substr(text, {s} + 601, 400), '(?s)^(.*\\s)', 1)) ELSE {s} + 1000 END"
SQL_ARTIFACTS = f"""artifacts AS (
  SELECT doc_id AS artifact_id, 'doc-' || doc_id || CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END AS title, CASE WHEN lang = 'en' THEN 'text/markdown' ELSE 'text/plain' END AS media_type,
    '/corpus/' || source || '/doc-' || doc_id || CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END AS source_uri, source AS root, source <> '{REVOKED}' AS enabled,
    {EPOCH_NS} + doc_id * {HOUR_NS} AS mtime_ns, 'sha256:' || sha256(text) AS content_hash, strlen(text)::BIGINT AS byte_size, regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g') AS text
  FROM documents)"""
SQL_PASSAGES = f"""{SQL_ARTIFACTS},
chunks AS (
  SELECT artifact_id, text, n, 0 AS s, {_END.format(s="0")} AS e FROM (SELECT *, length(text) AS n FROM artifacts) WHERE n > 0
  UNION ALL
  SELECT artifact_id, text, n, s, {_END.format(s="s")} AS e FROM (SELECT artifact_id, text, n, e - least(120, e - s - 1) AS s FROM chunks WHERE e < n)),
passages AS (
  SELECT c.artifact_id || ':' || ordinal AS passage_id, c.artifact_id * 1000000 + ordinal AS rowid, c.artifact_id, ordinal, char_start, char_end, passage_text,
    a.title, a.media_type, a.source_uri, a.root, a.enabled, a.mtime_ns, a.content_hash, a.text
  FROM (SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY s) - 1 AS ordinal, s::BIGINT AS char_start, e::BIGINT AS char_end, substr(text, s + 1, e - s) AS passage_text
    FROM chunks WHERE regexp_matches(substr(text, s + 1, e - s), '\\S')) c JOIN artifacts a USING (artifact_id))"""


def sql_tokens(text: str) -> str:
    """DuckDB expression for `tokenize_fts`."""
    return f"list_filter(string_split_regex(translate(lower({text}), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def sql_alnum(text: str) -> str:
    """DuckDB expression for `tokenize_alnum`."""
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def sql_normalized(text: str) -> str:
    """DuckDB expression for `normalize_fusion`."""
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
