"""Registered queries on cascades, stored snapshots, frames of captures and coalesced states, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cascade, snapshots
from lodestone.operators.cascade import Reference
from lodestone.plans import canonical as C
from lodestone.plans import stored
from lodestone.plans.storage import shared_dir
from lodestone.queries_records import observations
from lodestone.queries_records_sql import _OBS
from lodestone.streaming import captures, coalescing

#: What refers to what: keys of the tables, and their references.
KEYS = {"artifacts": "artifact_id", "locators": "locator", "versions": "version_id", "passages": "passage_id", "relationships": "id", "bookmark_records": "record_id", "import_items": "item_id"}
REFERENCES = (
    Reference("locators", "artifact_id", "artifacts"), Reference("versions", "artifact_id", "artifacts"), Reference("passages", "version_id", "versions"),
    Reference("relationships", "source_id", "artifacts"), Reference("relationships", "target_id", "artifacts"), Reference("relationships", "evidence_id", "passages", clears=True),
    Reference("bookmark_records", "artifact_id", "artifacts"), Reference("import_items", "record_id", "bookmark_records"),
)
CUTOFF_NS = C.EPOCH_NS + 50 * C.HOUR_NS


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables: every artifact has a locator and a version, src2's a second version with one passage; an artifact refers to the next one, and the
    evidence is the first passage of the one after that; every fifth is a bookmark with an import item."""
    a = C.artifacts(spark, sf_dir).select("artifact_id", "root", "source_uri", "mtime_ns")
    name = lambda prefix, i: F.concat(F.lit(prefix), i.cast("string"))
    i = F.col("artifact_id")
    p = stored.text_index(spark, sf_dir).passages().select("passage_id", name("a", i).alias("version_id"))
    second = a.where("root = 'src2'")
    return {
        "artifacts": a.select("artifact_id"), "locators": a.select(F.col("source_uri").alias("locator"), "artifact_id"),
        "versions": a.select(name("a", i).alias("version_id"), "artifact_id").union(second.select(name("b", i), "artifact_id")),
        "passages": p.union(second.select(F.concat(name("b", i), F.lit(":0")), name("b", i))),
        "relationships": a.select(name("r", i).alias("id"), F.col("artifact_id").alias("source_id"), (i + 1).alias("target_id"), F.concat((i + 2).cast("string"), F.lit(":0")).alias("evidence_id")),
        "bookmark_records": a.where(i % 5 == 0).select(name("m", i).alias("record_id"), "artifact_id"),
        "import_items": a.where(i % 5 == 0).select(name("i", i).alias("item_id"), name("m", i).alias("record_id")),
    }


def purge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts from before a cutoff, and those of src1, go with all that refers to them."""
    gone = C.artifacts(spark, sf_dir).where((F.col("mtime_ns") < CUTOFF_NS) | (F.col("root") == "src1")).select("artifact_id")
    return cascade.reported(_store(spark, sf_dir), KEYS, REFERENCES, {"artifacts": gone})


def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passage hashes against the stored snapshot of a manifest that lacks src9's and names src2's as they were."""
    p = stored.text_index(spark, sf_dir).passages().select(F.col("passage_id").alias("key"), F.sha2("passage_text", 256).alias("hash"), "root")
    at = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    snapshots.write_snapshot(p.where("root <> 'src9'").withColumn("hash", F.when(F.col("root") == "src2", "old").otherwise(F.col("hash"))), f"{at}/manifest")
    snapshots.write_snapshot(p, f"{at}/now")
    found = snapshots.differences(spark, f"{at}/manifest", f"{at}/now")
    return found.select(F.col("key").alias("passage_id"), F.when(F.col("why") == "added", "unexpected").when(F.col("why") == "removed", "absent").otherwise("differs").alias("problem"))


KEY, CHUNK, BASE_US = b"pairing key of the frames", 1024, 1_700_000_000_000_000


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of CHUNK bytes a frame, out of order within a second. Of pages divisible by 7 the first frame was changed after it was signed; by 11
    the last frame is three minutes late; by 13 the first is lost; by 17 the session has no life."""
    p = C.spread(C.table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("b")).where("octet_length(b) > 0"))
    n = F.ceil(F.octet_length("b") / CHUNK).cast("int")
    f = p.select("page_id", "b", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("sequence"))
    i, base = F.col("page_id"), F.lit(BASE_US) + F.col("page_id") * 1_000_000
    late = (i % 11 == 0) & (F.col("n") > 1) & (F.col("sequence") == F.col("n") - 1)
    order = F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), F.col("sequence").cast("string"))), 1, 3), 16, 10).cast("int") % 1000 * 1000
    data = F.substring("b", F.col("sequence") * CHUNK + 1, CHUNK)
    rows = f.select(
        i.cast("string").alias("request_id"), F.concat(F.lit("s"), (i % 10).cast("string")).alias("session"), base.alias("issued_us"), F.when(i % 17 == 0, base).otherwise(base + 600_000_000).alias("expires_us"), "sequence", (F.col("sequence") == F.col("n") - 1).alias("final"),
        F.octet_length(data).alias("bytes"), F.regexp_replace(F.base64(data), r"\s", "").alias("body"), F.sha2("b", 256).alias("content_hash"), (base + F.when(late, 180_000_000).otherwise(order)).alias("at_us"),
    )
    sent = captures.signed(rows, KEY)
    number = F.col("request_id").cast("long")
    forged = (number % 7 == 0) & (F.col("sequence") == 0)
    return sent.withColumn("body", F.when(forged, F.base64(F.lit("forged").cast("binary"))).otherwise(F.col("body"))).where(~((number % 13 == 0) & (F.col("sequence") == 0)))


def capture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.assembled(frames(spark, sf_dir), KEY)


def coalesced_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each batch as the keyed state leaves them, for the batches that need no full rescan."""
    e = observations(spark, sf_dir).withColumnRenamed("batch", "root")
    return coalescing.coalesced(coalescing.states(e), MAX_EVENTS).groupBy("root", "state").agg(F.count("*").alias("paths"))


MAX_EVENTS = 60
QUERIES = {f.__name__: f for f in (purge_cascade, manifest_validation, capture_frames, coalesced_states)}

_STORE = f"""WITH RECURSIVE {C.SQL_PASSAGES}, g AS (SELECT artifact_id FROM artifacts WHERE mtime_ns < {CUTOFF_NS} OR root = 'src1'),
ve AS (SELECT 'a' || artifact_id AS version_id, artifact_id FROM artifacts UNION ALL SELECT 'b' || artifact_id, artifact_id FROM artifacts WHERE root = 'src2'),
pa AS (SELECT passage_id, artifact_id FROM passages UNION ALL SELECT 'b' || artifact_id || ':0', artifact_id FROM artifacts WHERE root = 'src2'),
re AS (SELECT artifact_id AS s, artifact_id + 1 AS t, (artifact_id + 2) || ':0' AS e FROM artifacts),
bm AS (SELECT artifact_id FROM artifacts WHERE artifact_id % 5 = 0)"""


def _gone_sql(name: str, rows: str) -> str:
    bad = "artifact_id IN (FROM g)"
    return f"SELECT '{name}' AS relation, count(*) FILTER ({bad}) AS removed, 0::BIGINT AS cleared, count(*) FILTER (NOT {bad}) AS remaining FROM {rows}"


_FRAMES = f"""f AS (SELECT page_id, strlen(html) AS size, ceil(strlen(html) / {CHUNK}.0)::BIGINT AS n, sha256(html) AS sha, {BASE_US} + page_id * 1000000 AS base FROM pages WHERE strlen(html) > 0),
fr AS (SELECT f.*, s, base + CASE WHEN page_id % 11 = 0 AND n > 1 AND s = n - 1 THEN 180000000 ELSE ('0x' || substr(md5(page_id || ':' || s), 1, 3))::INTEGER % 1000 * 1000 END AS t_us, CASE WHEN s = n - 1 THEN size - (n - 1) * {CHUNK} ELSE {CHUNK} END AS bytes FROM f, unnest(range(0, n)) AS t(s) WHERE NOT (page_id % 13 = 0 AND s = 0)),
ls AS (SELECT *, min(t_us) OVER (PARTITION BY page_id) + {captures.LIFE_US} AS life, row_number() OVER (PARTITION BY page_id ORDER BY t_us, s) AS r FROM fr),
bd AS (SELECT *, CASE WHEN t_us > life THEN 'expired' WHEN page_id % 7 = 0 AND s = 0 THEN 'authentication_failed' WHEN page_id % 17 = 0 THEN 'session_expired' END AS bad FROM ls),
fb AS (SELECT page_id, min(r) FILTER (bad IS NOT NULL) AS br, arg_min(bad, r) FILTER (bad IS NOT NULL) AS bad, arg_min(t_us, r) FILTER (bad IS NOT NULL) AS bat, max(t_us) AS last, min(life) AS life, count(*) AS c, any_value(n) AS n, any_value(sha) AS sha FROM bd GROUP BY page_id),
st AS (SELECT *, coalesce(bad, CASE WHEN c = n THEN 'complete' ELSE 'expired' END) AS status FROM fb)"""
ORACLES = {
    "purge_cascade": f"""{_STORE} {" UNION ALL ".join(_gone_sql(n, r) for n, r in (("artifacts", "artifacts"), ("locators", "artifacts"), ("versions", "ve"), ("passages", "pa"), ("bookmark_records", "bm"), ("import_items", "bm")))}
UNION ALL SELECT 'relationships', count(*) FILTER (s IN (FROM g) OR t IN (FROM g)), count(*) FILTER (s NOT IN (FROM g) AND t NOT IN (FROM g) AND e IN (SELECT passage_id FROM pa WHERE artifact_id IN (FROM g))), count(*) FILTER (s NOT IN (FROM g) AND t NOT IN (FROM g)) FROM re""",
    "capture_frames": f"""WITH {_FRAMES} SELECT page_id::VARCHAR AS request_id, status, (SELECT count(*) FROM bd WHERE bd.page_id = st.page_id AND r < coalesce(br, c + 1))::INTEGER AS n_frames, coalesce((SELECT sum(bytes) FROM bd WHERE bd.page_id = st.page_id AND r < coalesce(br, c + 1)), 0)::BIGINT AS n_bytes,
  CASE WHEN status = 'complete' THEN sha END AS content_hash, CASE WHEN status = 'expired' THEN life WHEN bad IS NOT NULL THEN bat ELSE last END AS decided_us FROM st""",
    "coalesced_states": f"WITH {_OBS} SELECT batch AS root, state, count(*) AS paths FROM la JOIN fl USING (batch) WHERE n <= {MAX_EVENTS} GROUP BY ALL",
    "manifest_validation": f"WITH RECURSIVE {C.SQL_PASSAGES} SELECT passage_id, CASE WHEN root = 'src9' THEN 'unexpected' ELSE 'differs' END AS problem FROM passages WHERE root IN ('src2', 'src9')",
}
