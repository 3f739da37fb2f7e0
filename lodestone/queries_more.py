"""Further registered queries: visible edges, policies, owners, extractor output; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans import canonical as C
from lodestone.queries_records import edges
from lodestone.queries_records_sql import _EDGES, _GEO

EXCLUDED = ("error", "signup")


def revoked_endpoints(spark, sf_dir):
    """Edges whose two ends are both visible: suppliers with a balance, parts of some size."""
    s = C.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("source_id"))
    p = C.table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("P"), "p_partkey").alias("target_id"))
    e = edges(spark, sf_dir)
    shown = e.join(s, "source_id", "left_semi").join(p, "target_id", "left_semi")
    return shown.groupBy("kind", "origin").agg(F.count("*").alias("visible"))


def capture_policy(spark, sf_dir):
    """Events that are kept when two types are excluded."""
    e = C.table(spark, sf_dir, "events")
    excluded = spark.createDataFrame([(x,) for x in EXCLUDED], "event_type string")
    return e.join(F.broadcast(excluded), "event_type", "left_anti").groupBy("user_id").agg(F.count("*").alias("kept"))  # the policy's list


def bookmark_owners(spark, sf_dir):
    """Hosts that own a page or are linked as a document's source: a distinct union."""
    a = C.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("owner"))
    b = C.table(spark, sf_dir, "documents").select("source")
    return a.union(b).distinct()


def extractor_validation(spark, sf_dir):
    """Invariants of extractor output: regions inside their image, not empty, confidence in range; counts by what is wrong."""
    from lodestone.queries_records import ocr_geometry

    r = ocr_geometry(spark, sf_dir)
    swapped = F.col("l_linenumber").between(5, 8)
    w = F.when(swapped, 400 + F.col("l_suppkey")).otherwise(800 + F.col("l_partkey"))
    wrong = F.concat_ws(";", F.when(F.col("x") + F.col("width") > w, "outside"), F.when((F.col("width") < 1) | (F.col("height") < 1), "empty"), F.when(F.col("width") > 0.4 * w, "too_wide"))
    return r.groupBy(wrong.alias("problems")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (revoked_endpoints, capture_policy, bookmark_owners, extractor_validation)}

_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


ORACLES = {
    "revoked_endpoints": f"WITH {_EDGES} SELECT kind, origin, count(*) AS visible FROM e WHERE source_id IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0) AND target_id IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 10) GROUP BY ALL",
    "capture_policy": f"SELECT user_id, count(*) AS kept FROM events WHERE event_type NOT IN {EXCLUDED} GROUP BY 1",
    "bookmark_owners": f"SELECT {_HOST} AS owner FROM pages UNION SELECT source FROM documents",
    "extractor_validation": f"WITH {_GEO} SELECT concat_ws(';', CASE WHEN px + pw > ow THEN 'outside' END, CASE WHEN pw < 1 OR ph < 1 THEN 'empty' END, CASE WHEN pw > 0.4::DOUBLE * ow THEN 'too_wide' END) AS problems, count(*) AS n FROM b GROUP BY 1",
}
