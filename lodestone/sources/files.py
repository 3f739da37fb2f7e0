"""Files as sources: bounded discovery, fingerprints, text extraction, query files; pages and image regions as passages."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodestone.functions import html
from lodestone.functions import text as T
from lodestone.operators.records import digest_tree

#: Bounds of one discovery.
MAX_ENTRIES, MAX_DEPTH, MAX_PATH_BYTES, MAX_FILE_BYTES = 65_536, 32, 4_096, 8 * 1024 * 1024
MAX_DIRECTORIES, MAX_RETAINED_BYTES, MAX_SECONDS = 4_096, 8 * 1024 * 1024, 5.0
ANCHOR = S.StructType([
    *(S.StructField(n, S.StringType()) for n in ("kind", "contains")),
    *(S.StructField(n, S.LongType()) for n in ("page", "char_start", "char_end", "line_start", "line_end", "x", "y", "width", "height", "image_width", "image_height", "orientation", "scale_milli", "confidence_milli")),
])
ALTERNATIVE = S.StructType([S.StructField("expected_file", S.StringType()), S.StructField("expected_anchor", ANCHOR)])
QUERY_FILE = S.StructType([
    S.StructField("id", S.StringType()), S.StructField("query", S.StringType()), S.StructField("source_type", S.StringType()), S.StructField("expected_file", S.StringType()), S.StructField("expected_anchor", ANCHOR),
    S.StructField("acceptable_alternatives", S.ArrayType(ALTERNATIVE)), S.StructField("reformulations", S.ArrayType(S.StringType())), S.StructField("negative", S.BooleanType()),
])


class DiscoveryRefused(ValueError):
    """A folder beyond a bound: nothing of it is taken."""


ENTRY = "path string, kind string, bytes long, modified_ns long, depth int"


def walk(spark: SparkSession, path: str, max_entries: int = MAX_ENTRIES, max_directories: int = MAX_DIRECTORIES, max_depth: int = MAX_DEPTH, max_path_bytes: int = MAX_PATH_BYTES, max_retained: int = MAX_RETAINED_BYTES, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """Every entry below a folder, level by level: ENTRY; the folder itself has depth 0. Symbolic links are listed, not followed.

    A listing is an iterator that is left at the first bound that is passed (entries, directories, depth, bytes of a path, bytes of all paths
    that are kept, seconds), so a tree beyond one is refused before it is listed whole, and what the driver holds is bounded."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    began, retained, directories = time.monotonic(), 0, 1
    root = fs.getFileStatus(top)
    rows, level, depth = [(root.getPath().toString(), "directory", 0, root.getModificationTime() * 1_000_000, 0)], [root.getPath()], 0
    refuse = lambda what: DiscoveryRefused(f"{path}: {what} after {len(rows) - 1} entries")
    while level:
        depth, below = depth + 1, []
        for folder in level:
            listing = fs.listStatusIterator(folder)
            while listing.hasNext():
                s = listing.next()
                name, folder_kind = s.getPath().toString(), s.isDirectory()
                size = len(name.encode())
                retained, directories = retained + size, directories + folder_kind
                bounds = (("depth", depth, max_depth), ("entries", len(rows), max_entries), ("directories", directories, max_directories), ("path bytes", size, max_path_bytes), ("retained bytes", retained, max_retained), ("seconds", time.monotonic() - began, max_seconds))
                if passed := [f"more than {most} {what}" for what, now, most in bounds if now > most]:
                    raise refuse(passed[0])
                rows.append((name, "directory" if folder_kind else "link" if s.isSymlink() else "file", 0 if folder_kind else s.getLen(), s.getModificationTime() * 1_000_000, depth))
                if folder_kind:
                    below.append(s.getPath())
        level = below
    return spark.createDataFrame(rows, ENTRY)


def discover(spark: SparkSession, path: str, max_files: int = MAX_ENTRIES, **bounds) -> DataFrame:
    """Supported files below a folder: path, media_type, modified_ns, bytes, position (component-wise order). Beyond a bound of `walk`, or with
    more than max_files supported files, the whole discovery is refused."""
    found = walk(spark, path, **bounds).where("kind = 'file'").withColumn("media_type", html.media_type(F.col("path")))
    kept = found.where("media_type is not null")
    if (n := kept.count()) > max_files:
        raise DiscoveryRefused(f"{path}: {n} files")
    order = Window.orderBy(F.split("path", "/"))  # at most max_files rows
    return kept.select("path", "media_type", "modified_ns", "bytes", (F.row_number().over(order) - 1).cast("long").alias("position"))


def namespace_fingerprint(entries: DataFrame) -> DataFrame:
    """entries: of `walk`. One digest of the whole tree with its directories (path, kind, time) and files (also sizes), in component-wise
    order: a file that comes, goes or changes, and a directory that is replaced, give another one."""
    order = Window.orderBy(F.split("path", "/"))  # at most MAX_ENTRIES rows
    named = entries.select((F.row_number().over(order) - 1).cast("long").alias("position"), F.sha2(F.concat_ws("\x00", "path", "kind", F.col("bytes").cast("string"), F.col("modified_ns").cast("string")), 256).alias("h"))
    return digest_tree(named, "position", "h", levels=2)


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest of a discovery: names, sizes and times in order."""
    return digest_tree(files.select("position", F.sha2(F.concat_ws("\x00", "path", "bytes", "modified_ns"), 256).alias("h")), "position", "h", levels=2)


def extract_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files: path, media_type, content_hash, text, problem (null if it was extracted).

    Too large, not UTF-8, or with control characters: no text, and the reason."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.withColumn("media_type", html.media_type(F.col("path"))).where(F.startswith("media_type", F.lit("text/")))
    problem = F.when(F.col("length") > MAX_FILE_BYTES, "too_large").when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8").otherwise(html.text_problem(F.col("content").cast("string")))
    out = f.select("path", "media_type", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), problem.alias("problem"), F.when(problem.isNull(), T.normalized_lines(F.col("content").cast("string"))).alias("text"))
    return out


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries, one JSON object a line; a damaged line fails the read."""
    return spark.read.schema(QUERY_FILE).option("mode", "FAILFAST").json(path)


def page_passages(pages: DataFrame, target: int = T.TARGET, overlap: int = T.OVERLAP) -> DataFrame:
    """pages: doc_id, page, text. Passages of each page; anchors are of the page, ordinals go on through the document."""
    rows = pages.select("doc_id", "page", F.posexplode(T.split_passages(F.regexp_replace("text", "^\n+|\n+$", ""), target, overlap)).alias("pos", "p"))
    w = Window.partitionBy("doc_id").orderBy("page", "pos")
    return rows.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "page", F.col("p.char_start").alias("char_start"), F.col("p.char_end").alias("char_end"), F.col("p.text").alias("text"))


def region_passages(regions: DataFrame) -> DataFrame:
    """regions: image_id, idx, text. One passage a region, at its place in the regions' texts joined by line feeds."""
    w = Window.partitionBy("image_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    line = F.row_number().over(Window.partitionBy("image_id").orderBy("idx"))
    return regions.select("image_id", (line - 1).cast("long").alias("ordinal"), start.alias("char_start"), (start + F.length("text")).alias("char_end"), line.cast("long").alias("line"), "text")
