"""Registered queries on the merges of the evidence store, with their SQL. Each runs the operator; where the driver's tables
have no such data, the plain rules given here make the store's tables from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import jobs, merges
from lodestone.plans import canonical as C
from lodestone.plans import stored
from lodestone.plans.storage import written
from lodestone.queries_records import REMOVALS, edges, observations
from lodestone.queries_records_sql import _A, _DOMINATED, _EDGES, _P
from lodestone.streaming import events as E

SITE, HOST, MARK = "^https?://(www[.]|m[.]|blog[.])?([^/?#]*)", "://([^/?#]*)", "utm_|ref="
BUDGETS = {"view": ("max", 500.0), "click": ("min", 0.0), "purchase": ("max", 1.0), "absent": ("max", 1.0)}
EXCLUDED_HOST, N_ROOTS = "spam-farm.example.org", 10


def _changed() -> F.Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat("text", F.lit("\nmore")), 256))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored versions: the text of every artifact but src5's; for src2 the text to come as an older version; for src6 recognised text."""
    a = C.artifacts(spark, sf_dir)
    row = lambda where, name, content, extractor, active, state: a.where(where).select("artifact_id", "root", content.alias("content_hash"), F.lit(extractor).alias("extractor"), F.lit("1").alias("extractor_version"), F.concat(F.lit(name), "artifact_id").alias("version_id"), F.lit(active).alias("active"), F.lit(state).alias("state"))
    return row("root <> 'src5'", "a", F.col("content_hash"), "text", True, "ready").union(row("root = 'src2'", "b", _changed(), "text", False, "superseded")).union(row("root = 'src6'", "o", F.lit("ocr"), "ocr", False, "ready"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source as it is now: src3 is gone, French texts have changed, src5 is new, src1 has another extractor."""
    a = C.artifacts(spark, sf_dir).where("root <> 'src3'")
    content = F.when(F.endswith("title", F.lit(".txt")), _changed()).otherwise(F.col("content_hash"))
    return a.select("artifact_id", "root", content.alias("content_hash"), F.lit("text").alias("extractor"), F.when(F.col("root") == "src1", "2").otherwise("1").alias("extractor_version"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.upsert_versions(versions(spark, sf_dir), scan(spark, sf_dir))


def index_upsert(spark, sf_dir):
    return _merged(spark, sf_dir).select("artifact_id", "outcome", "version_id")


def index_totals(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


def bookmark_supersede(spark, sf_dir):
    return merges.superseded(versions(spark, sf_dir), _merged(spark, sf_dir)).select("version_id", "state", "active")


def event_reconcile(spark, sf_dir):
    r = E.reconciled(observations(spark, sf_dir), versions(spark, sf_dir), scan(spark, sf_dir))
    return r.groupBy("outcome").agg(F.count("*").alias("n"), F.min("artifact_id").alias("first_id"))


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots as probed: one symlink, one gone, one denied, one a file, one unknown; the others are folders."""
    probes = {"src1": "symlink", "src2": "absent", "src13": "denied", "src14": "file"}
    probe = reduce(lambda c, kv: c.when(F.col("root_id") == kv[0], kv[1]), probes.items(), F.when(F.col("root_id") == "src15", None))
    r = C.artifacts(spark, sf_dir).groupBy(F.col("root").alias("root_id")).agg(F.bool_and("enabled").alias("enabled"))
    return r.select("root_id", "enabled", F.lit("directory").alias("kind"), probe.otherwise("directory").alias("probe"))


def source_roots(spark, sf_dir):
    return merges.root_status(_probed(spark, sf_dir)).select("root_id", "status")


def startup_reconcile(spark, sf_dir):
    return E.startup(_probed(spark, sf_dir), versions(spark, sf_dir).withColumnRenamed("root", "root_id"), scan(spark, sf_dir).withColumnRenamed("root", "root_id"))


def ocr_purge(spark, sf_dir):
    """What is left of each root when recognised text goes; src6's passages were made twice."""
    v = versions(spark, sf_dir)
    p = C.passages(spark, sf_dir).where("root <> 'src5'").select(F.explode(F.when(F.col("root") == "src6", F.array(F.lit("a"), F.lit("o"))).otherwise(F.array(F.lit("a")))).alias("k"), "artifact_id")
    left, rest = merges.purge_extractor(v, p.select(F.concat("k", "artifact_id").alias("version_id")), "ocr")
    n = rest.groupBy("version_id").agg(F.count("*").alias("n"))
    return left.join(n, "version_id", "left").groupBy("root").agg(F.count("*").alias("versions"), F.count_distinct("artifact_id").alias("artifacts"), F.coalesce(F.sum("n"), F.lit(0)).alias("passages"))


def active_evidence(spark, sf_dir):
    """Artifacts of enabled roots whose active version and locator are there; every seventh locator is inactive, every fifth artifact missing."""
    a = C.artifacts(spark, sf_dir)
    arts = a.select("artifact_id", F.when(F.col("artifact_id") % 5 == 0, "missing").otherwise("active").alias("state"), F.concat(F.lit("a"), "artifact_id").alias("active_version_id"), F.col("root").alias("root_id"))
    roots = a.groupBy(F.col("root").alias("root_id")).agg(F.bool_and("enabled").alias("enabled"))
    return merges.active_evidence(arts, versions(spark, sf_dir), roots, a.select("artifact_id", F.col("source_uri").alias("locator"), (F.col("artifact_id") % 7 != 0).alias("active")))


def evidence_endpoint(spark, sf_dir):
    """Edges from each artifact to the next one; their evidence is the first passage of one of the ends or, for a third, of neither."""
    a = C.artifacts(spark, sf_dir).select("artifact_id")
    e = a.select(F.col("artifact_id").alias("id"), F.col("artifact_id").alias("source_id"), (F.col("artifact_id") + 1).alias("target_id"), F.concat(F.col("artifact_id") + F.col("artifact_id") % 3, F.lit(":0")).alias("evidence_id"))
    return merges.evidence_at_endpoint(e, C.passages(spark, sf_dir)).select("id", "evidence_id")


def bookmarks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as bookmarks of their site and language in a folder by subdomain and parity. Every third is stored already, by export a or b; the others come from a."""
    p = C.table(spark, sf_dir, "pages")
    site, lang = F.regexp_extract("url", SITE, 2), F.regexp_extract("url", "/(de|en|es|fr)/", 1)
    owner = F.when(F.col("page_id") % 15 == 0, "b").otherwise("a")
    title, added = F.concat(F.lit("T"), F.floor(F.col("page_id") / 2) % 2), F.when(F.col("page_id") % 4 > 0, F.lit("2024"))
    rows = p.select(F.col("page_id").alias("ordinal"), F.concat(F.lit("http://"), site, F.lit("/"), lang).alias("url"), F.concat(F.regexp_extract("url", SITE, 1), F.col("page_id") % 2).alias("folder"), merges.entry_hash(title, added, F.lit(None).cast("string")).alias("entry"), owner.alias("owner"))
    first = rows.where("ordinal % 3 = 0").groupBy("url", "folder").agg(F.min(F.struct("ordinal", "entry", "owner")).alias("f"))
    return first.select("url", "folder", "f.entry", "f.owner"), rows.where("ordinal % 3 > 0 and owner = 'a'")


def bookmark_merge(spark, sf_dir):
    return merges.merge_bookmarks(*bookmarks(spark, sf_dir)).select("ordinal", "outcome")


def owner_failures(spark, sf_dir):
    return merges.merge_bookmarks(*bookmarks(spark, sf_dir)).where(F.col("outcome") == merges.OTHER_OWNER).select("ordinal", "url", F.col("outcome").alias("code"))


def bookmark_conflicts(spark, sf_dir):
    """URLs of the import that are in more than one folder."""
    _, i = bookmarks(spark, sf_dir)
    return i.groupBy("url").agg(F.count_distinct("folder").alias("folders"), F.count("*").alias("n")).where("folders > 1")


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as imports of their customer's locator; status P is revoked, and its locator has moved."""
    o, root = C.table(spark, sf_dir, "orders"), F.col("o_custkey") % N_ROOTS
    p = F.col("o_orderstatus") == "P"
    return o.select(F.col("o_orderkey").alias("import_id"), root.alias("root_id"), F.col("o_custkey").alias("customer"), F.when(p, "moved").otherwise(F.concat(F.lit("loc"), root)).alias("locator"), F.col("o_orderdate").alias("imported_at"), F.when(p, "revoked").otherwise("complete").alias("status"))


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = C.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return x.select(F.col("l_orderkey").alias("import_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.when(F.col("l_linestatus") == "F", merges.OTHER_OWNER).otherwise("invalid_url").alias("code"))


def _file_roots(spark: SparkSession) -> DataFrame:
    return spark.range(N_ROOTS).select(F.col("id").alias("root_id"), (F.col("id") != 3).alias("enabled"), F.when(F.col("id") == 7, "directory").otherwise("file").alias("kind"), F.concat(F.lit("loc"), "id").alias("locator"))


def import_retry(spark, sf_dir):
    i = _imports(spark, sf_dir).withColumn("locator", F.col("customer").cast("string"))
    return merges.failure_states(i, _failed(spark, sf_dir), _file_roots(spark))


def import_requests(spark, sf_dir):
    """Every third import asks again; its bytes are those of its customer's orders of one priority, and the others are what has been imported."""
    i = _imports(spark, sf_dir).join(C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("import_id"), F.col("o_orderpriority").alias("content_hash")), "import_id")
    i = i.withColumn("locator", F.col("customer").cast("string"))
    requests = i.where(F.col("import_id") % 3 == 0).select(F.col("import_id").alias("request_id"), "root_id", "locator", "content_hash")
    return merges.import_requests(requests, i.where(F.col("import_id") % 3 > 0), _failed(spark, sf_dir), _file_roots(spark))


def import_summaries(spark, sf_dir):
    s = merges.import_summaries(_imports(spark, sf_dir), _failed(spark, sf_dir))
    shown = F.array_join(F.transform("failures", lambda f: F.concat_ws(":", f["ordinal"], f["code"])), ",")
    return s.select("import_id", "status", F.size("failures").cast("long").alias("n_failures"), shown.alias("failures"))


def scope_consistency(spark, sf_dir):
    """Imports (orders), bookmarks (parts) with items (line items), and failures settled by the next import."""
    r = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bookmark_id"), (F.col("p_partkey") % N_ROOTS).alias("root_id"), F.col("p_partkey").alias("first_import"))
    items = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("import_id"), F.col("l_partkey").alias("bookmark_id"))
    i = _imports(spark, sf_dir).select("import_id", "root_id", "locator")
    f = i.select("import_id", (F.col("import_id") + 1).alias("resolved_by"))
    return merges.scope_problems(_file_roots(spark), i, r, items, f)


def rel_add(spark, sf_dir):
    """Edges of odd orders added to those of even ones; small parts are unknown."""
    e = edges(spark, sf_dir).withColumn("method", F.when(F.col("confidence").isNull(), "manual").otherwise("rule"))
    even = F.split("id", "-")[0].cast("long") % 2 == 0
    parts = C.table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    nodes = C.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node")).union(parts)
    return merges.add_relationships(e.where(even), e.where(~even), nodes).groupBy("outcome").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("kept_id").alias("last_kept"))


def rel_compaction_report(spark, sf_dir):
    return merges.compaction_report(edges(spark, sf_dir), REMOVALS)


def revoke_root(spark, sf_dir):
    """States of roots, artifacts, imports and jobs after src4 is revoked; every third artifact has a running job."""
    a = C.artifacts(spark, sf_dir).withColumnRenamed("root", "root_id")
    roots = a.groupBy("root_id").agg(F.bool_and("enabled").alias("enabled"), F.lit(0).alias("generation"))
    arts = a.select("root_id", F.when(F.col("enabled"), "active").otherwise("missing").alias("state"))
    work = a.select("root_id", F.when(F.col("artifact_id") % 3 == 0, "running").otherwise("completed").alias("state"))
    out = merges.revoke("src4", roots, arts, a.select("root_id", F.lit("complete").alias("status")), work)
    shown = {"roots": F.concat_ws("/", F.col("enabled").cast("string"), "generation"), "artifacts": F.col("state"), "imports": F.col("status"), "jobs": F.col("state")}
    return reduce(DataFrame.union, (out[n].groupBy(F.lit(n).alias("relation"), "root_id", s.alias("state")).agg(F.count("*").alias("n")) for n, s in shown.items()))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = C.artifacts(spark, sf_dir)
    old = F.endswith("title", F.lit(".txt")) & (F.col("byte_size") % 2 == 0)
    unit = F.row_number().over(Window.partitionBy("root").orderBy("artifact_id")) - 1
    return a.select(F.col("root").alias("job_id"), unit.cast("long").alias("unit"), F.col("source_uri").alias("path"), F.when(old, "old").otherwise(F.col("content_hash")).alias("stored_hash"), F.col("content_hash").alias("hash"), F.lit("f").alias("fingerprint"))


def _work(units: DataFrame) -> DataFrame:
    """One job a root, two units before its end; src6's is completed, src9's has another fingerprint, src10's has done all."""
    j = units.groupBy("job_id").agg(F.count("*").alias("total"))
    left = F.when(F.col("job_id") == "src10", 0).otherwise(2)
    return j.select("job_id", "total", F.greatest(F.col("total") - left, F.lit(0)).alias("next_unit"), F.when(F.col("job_id") == "src6", "completed").otherwise("interrupted").alias("state"), F.when(F.col("job_id") == "src9", "g").otherwise("f").alias("fingerprint"))


def resume_checkpoint(spark, sf_dir):
    u = _units(spark, sf_dir)
    return merges.resume(_work(u), u)


def directory_quanta(spark, sf_dir):
    u = _units(spark, sf_dir)
    return jobs.directory_quanta(_work(u), u)


def index_batches(spark, sf_dir):
    """A batch a root: French artifacts are indexed, English ones unchanged, some fail."""
    txt, bad = F.endswith("title", F.lit(".txt")), F.col("byte_size") % 97 == 0
    b = C.artifacts(spark, sf_dir).groupBy("root").agg(F.count("*").alias("discovered"), F.count_if(txt & ~bad).alias("indexed"), F.count_if(~txt & ~bad).alias("unchanged"), F.count_if(bad).alias("failed"), F.sum("byte_size").alias("elapsed_ms"))
    t = merges.batch_totals(b)
    return t.withColumn("per_second", F.round("per_second", 6))


def performance_gate(spark, sf_dir):
    """Event values as runs of three scales."""
    e = C.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("scale"), F.col("event_type").alias("metric"), "value")
    return merges.budget_gate(e, BUDGETS).withColumn("worst", F.round("worst", 6))


def captured_images(spark, sf_dir):
    """Pages as screenshots of the app that their host is; every third is no image."""
    p = C.table(spark, sf_dir, "pages")
    rows = p.select(F.col("page_id").alias("image_id"), F.when(F.col("page_id") % 3 == 0, "text/html").otherwise("image/png").alias("media_type"), F.col("html").cast("binary").alias("bytes"), F.regexp_extract("url", HOST, 1).alias("app"), F.lit("w").alias("window_title"), "url", F.col("page_id").alias("captured_at"))
    excluded = spark.createDataFrame([(EXCLUDED_HOST,)], "app string")
    return merges.captured_images(rows, False, excluded).select("artifact_id", "content_hash", "byte_size", F.col("context.app").alias("app"))


def fts_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and vocabulary as the texts give them and as the index holds them: counts and digests."""
    index = stored.text_index(spark, sf_dir)
    p = written(C.passages(spark, sf_dir).select("rowid", F.sha2("passage_text", 256).alias("text_hash"), T.tokenize_fts(F.col("passage_text")).alias("t")), "tokens")
    a = p.agg(F.count("*").alias("passages"), F.sum(F.size("t")).alias("tokens"), F.count_if(F.size("t") == 0).alias("without"), merges.set_digest(merges.passage_row()).alias("passage_digest"))
    each = index.blocks().select(F.inline(F.arrays_zip("slots", "counts"))).groupBy("slots").agg(F.sum("counts").alias("n"))
    c = each.agg(F.count("*").alias("indexed_passages"), F.sum("n").alias("indexed_tokens"))
    # a term's passages in the text: counts by passage are partial sums, so hot terms are counted before the exchange
    once = p.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("doc"))
    times = p.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))
    want, have = merges.vocabulary_digest(once.join(times, "term")), merges.vocabulary_digest(index.vocabulary())
    out = a.crossJoin(c).crossJoin(want.toDF("vocabulary_digest")).crossJoin(have.toDF("indexed_digest"))  # one row each
    healthy = (F.col("passages") - F.col("without") == F.col("indexed_passages")) & (F.col("vocabulary_digest") == F.col("indexed_digest"))
    return out.select("passages", "tokens", "indexed_passages", "indexed_tokens", "passage_digest", "vocabulary_digest", healthy.alias("healthy"))


QUERIES = {
    f.__name__: f
    for f in (
        index_upsert, index_totals, bookmark_supersede, event_reconcile, source_roots, startup_reconcile, ocr_purge, active_evidence, evidence_endpoint, bookmark_merge, owner_failures, bookmark_conflicts, import_retry, import_requests, import_summaries,
        scope_consistency, rel_add, rel_compaction_report, revoke_root, resume_checkpoint, directory_quanta, index_batches, performance_gate, captured_images, fts_health,
    )
}

_H2 = "'sha256:' || sha256(text || chr(10) || 'more')"
_VERSIONS = f"""{_A}, vs AS (SELECT artifact_id, root, content_hash, 'text' AS extractor, '1' AS ev, 'a' || artifact_id AS version_id, true AS active, 'ready' AS state FROM artifacts WHERE root <> 'src5'
  UNION ALL SELECT artifact_id, root, {_H2}, 'text', '1', 'b' || artifact_id, false, 'superseded' FROM artifacts WHERE root = 'src2'
  UNION ALL SELECT artifact_id, root, 'ocr', 'ocr', '1', 'o' || artifact_id, false, 'ready' FROM artifacts WHERE root = 'src6'),
sc AS (SELECT artifact_id, root, CASE WHEN title LIKE '%.txt' THEN {_H2} ELSE content_hash END AS content_hash, 'text' AS extractor, CASE WHEN root = 'src1' THEN '2' ELSE '1' END AS ev FROM artifacts WHERE root <> 'src3'),
pb AS (SELECT root AS root_id, bool_and(enabled) AS enabled, CASE root WHEN 'src15' THEN 'unavailable' WHEN 'src1' THEN 'unsafe' WHEN 'src2' THEN 'missing' WHEN 'src13' THEN 'denied' WHEN 'src14' THEN 'wrong_type' ELSE 'available' END AS probed FROM artifacts GROUP BY root),
rs AS (SELECT root_id, CASE WHEN enabled THEN probed ELSE 'revoked' END AS status FROM pb)"""


def _merge_sql(vs: str, sc: str) -> str:
    return f"""mg AS (SELECT i.artifact_id, i.root, CASE WHEN v.active THEN 'unchanged' WHEN v.version_id IS NOT NULL THEN 'reused' WHEN i.artifact_id IN (SELECT artifact_id FROM {vs}) THEN 'updated' ELSE 'inserted' END AS outcome,
  coalesce(v.version_id, sha256(concat_ws(chr(31), i.artifact_id, i.content_hash, i.extractor, i.ev))) AS version_id
  FROM {sc} i LEFT JOIN (SELECT artifact_id, content_hash, extractor, ev, bool_or(active) AS active, min(version_id) AS version_id FROM {vs} GROUP BY ALL) v ON v.artifact_id = i.artifact_id AND v.content_hash = i.content_hash AND v.extractor = i.extractor AND v.ev = i.ev
  UNION ALL SELECT artifact_id, root, 'missing', NULL FROM {vs} WHERE active AND artifact_id NOT IN (SELECT artifact_id FROM {sc}))"""


_MERGED = f"{_VERSIONS}, {_merge_sql('vs', 'sc')}"
_BOOKMARKS = f"""bm AS (SELECT page_id AS ordinal, 'http://' || regexp_extract(url, '{SITE}', 2) || '/' || regexp_extract(url, '/(de|en|es|fr)/', 1) AS url, regexp_extract(url, '{SITE}', 1) || (page_id % 2) AS folder, 'T' || (page_id // 2 % 2) || CASE WHEN page_id % 4 > 0 THEN '/2024' ELSE '' END AS entry, CASE WHEN page_id % 15 = 0 THEN 'b' ELSE 'a' END AS owner FROM pages),
st AS (SELECT url, folder, arg_min(entry, ordinal) AS entry, arg_min(owner, ordinal) AS owner FROM bm WHERE ordinal % 3 = 0 GROUP BY ALL),
ic AS (SELECT * FROM bm WHERE ordinal % 3 > 0 AND owner = 'a'),
w AS (SELECT ordinal, url, folder, entry, lag(entry) OVER k AS before_, row_number() OVER k AS nth, count(*) OVER (PARTITION BY url ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - (row_number() OVER k - 1) AS others FROM ic WINDOW k AS (PARTITION BY url, folder ORDER BY ordinal)),
mb AS (SELECT w.ordinal, w.url, CASE WHEN w.url IN (SELECT url FROM st WHERE owner <> 'a') THEN '{merges.OTHER_OWNER}' WHEN (nth > 1 OR st.entry IS NOT NULL) AND coalesce(before_, st.entry) = w.entry THEN 'unchanged' WHEN nth > 1 OR st.entry IS NOT NULL THEN 'merged' WHEN others > 0 OR w.url IN (SELECT url FROM st) THEN 'conflict' ELSE 'imported' END AS outcome FROM w LEFT JOIN st ON st.url = w.url AND st.folder = w.folder)"""
_IMPORTS = f"""im AS (SELECT o_orderkey AS import_id, o_custkey % {N_ROOTS} AS root_id, o_custkey AS customer, CASE WHEN o_orderstatus = 'P' THEN 'moved' ELSE 'loc' || (o_custkey % {N_ROOTS}) END AS locator, o_orderdate AS imported_at, CASE WHEN o_orderstatus = 'P' THEN 'revoked' ELSE 'complete' END AS status FROM orders),
fa AS (SELECT l_orderkey AS import_id, l_linenumber::BIGINT AS ordinal, CASE WHEN l_linestatus = 'F' THEN '{merges.OTHER_OWNER}' ELSE 'invalid_url' END AS code FROM lineitem WHERE l_returnflag = 'R')"""
_UNITS = f"""{_A}, un AS (SELECT root AS job_id, row_number() OVER (PARTITION BY root ORDER BY artifact_id) - 1 AS unit, source_uri AS path, title LIKE '%.txt' AND byte_size % 2 = 0 AS old FROM artifacts),
wk AS (SELECT job_id, count(*) AS total, greatest(count(*) - CASE WHEN job_id = 'src10' THEN 0 ELSE 2 END, 0) AS next_unit FROM un GROUP BY job_id)"""
_TERMS = f"{_P}, tk AS (SELECT rowid, passage_text, {C.sql_tokens('passage_text')} AS toks FROM passages)"


def _digest_sql(row: str) -> str:
    value = lambda i: f"('0x' || substr(sha256({row}), {1 + 15 * i}, 15))::BIGINT"
    return " || ' ' || ".join(f"lpad(lower(to_hex(bit_xor({value(i)}))), 15, '0') || '+' || sum({value(i)})::VARCHAR" for i in range(4))


def _relation(name: str, rows: str, state: str) -> str:
    return f"SELECT '{name}' AS relation, root AS root_id, {state} AS state, count(*) AS n FROM {rows} GROUP BY ALL"


ORACLES = {
    "index_upsert": f"{_MERGED} SELECT artifact_id, outcome, version_id FROM mg",
    "index_totals": f"{_MERGED} SELECT outcome, count(*) AS n FROM mg GROUP BY 1",
    "bookmark_supersede": f"{_MERGED}, ch AS (SELECT artifact_id, version_id AS chosen FROM mg WHERE outcome IN ('reused', 'updated')) SELECT version_id, CASE WHEN chosen IS NULL THEN state WHEN version_id = chosen THEN 'ready' WHEN state = 'ready' THEN 'superseded' ELSE state END AS state, CASE WHEN chosen IS NULL THEN active ELSE version_id = chosen END AS active FROM vs LEFT JOIN ch USING (artifact_id)",
    "event_reconcile": f"{_MERGED} SELECT outcome, count(*) AS n, min(artifact_id) AS first_id FROM mg WHERE (SELECT count(*) FROM events) > 0 GROUP BY 1",
    "source_roots": f"{_VERSIONS} SELECT root_id, status FROM rs",
    "startup_reconcile": f"{_VERSIONS}, v1 AS (SELECT * FROM vs WHERE root IN (SELECT root_id FROM rs WHERE status = 'available')), s1 AS (SELECT * FROM sc WHERE root IN (SELECT root_id FROM rs WHERE status = 'available')), {_merge_sql('v1', 's1')} SELECT root_id, nullif(status, 'available') AS failure, " + ", ".join(f"count(*) FILTER (outcome = '{n}') AS {n}" for n in ("inserted", "updated", "reused", "unchanged", "missing")) + " FROM rs LEFT JOIN mg ON mg.root = root_id WHERE status <> 'revoked' GROUP BY ALL",
    "ocr_purge": f"{_P}, n AS (SELECT artifact_id, count(*) AS k FROM passages GROUP BY 1) SELECT root, count(*) + count(*) FILTER (root = 'src2') AS versions, count(*) AS artifacts, coalesce(sum(k), 0)::BIGINT AS passages FROM artifacts LEFT JOIN n USING (artifact_id) WHERE root <> 'src5' GROUP BY root",
    "active_evidence": f"{_VERSIONS} SELECT artifact_id, 'a' || artifact_id AS version_id, source_uri AS locator FROM artifacts WHERE enabled AND root <> 'src5' AND artifact_id % 5 <> 0 AND artifact_id % 7 <> 0",
    "evidence_endpoint": f"{_P} SELECT artifact_id AS id, (artifact_id + artifact_id % 3) || ':0' AS evidence_id FROM artifacts WHERE artifact_id % 3 < 2 AND (artifact_id + artifact_id % 3) || ':0' IN (SELECT passage_id FROM passages)",
    "bookmark_merge": f"WITH {_BOOKMARKS} SELECT ordinal, outcome FROM mb",
    "owner_failures": f"WITH {_BOOKMARKS} SELECT ordinal, url, outcome AS code FROM mb WHERE outcome = '{merges.OTHER_OWNER}'",
    "bookmark_conflicts": f"WITH {_BOOKMARKS} SELECT url, count(DISTINCT folder) AS folders, count(*) AS n FROM ic GROUP BY url HAVING count(DISTINCT folder) > 1",
    "import_requests": f"""WITH {_IMPORTS}, ia AS (SELECT im.*, o_orderpriority AS hash FROM im JOIN orders ON o_orderkey = import_id), ol AS (SELECT * FROM ia WHERE import_id % 3 > 0),
sm AS (SELECT customer, hash, arg_max(import_id, (imported_at, import_id)) AS import_id FROM ol WHERE status <> 'revoked' GROUP BY ALL), nw AS (SELECT customer, arg_max(import_id, (imported_at, import_id)) AS newest FROM ol GROUP BY 1),
ag AS (SELECT import_id, count(*) AS retried FROM fa JOIN ol USING (import_id) JOIN nw USING (customer) WHERE newest = import_id AND status <> 'revoked' AND root_id <> 3 AND code = '{merges.OTHER_OWNER}' GROUP BY 1)
SELECT r.import_id AS request_id, CASE WHEN sm.import_id IS NULL THEN 'new' ELSE 'reused' END AS outcome, sm.import_id, coalesce(retried, 0) AS retried FROM (SELECT * FROM ia WHERE import_id % 3 = 0) r LEFT JOIN sm ON sm.customer = r.customer AND sm.hash = r.hash LEFT JOIN ag ON ag.import_id = sm.import_id""",
    "import_retry": f"WITH {_IMPORTS}, nw AS (SELECT customer, arg_max(import_id, (imported_at, import_id)) AS newest FROM im GROUP BY 1) SELECT import_id, ordinal, code, CASE WHEN newest = import_id THEN 'pending' ELSE 'resolved' END AS state, newest = import_id AND status <> 'revoked' AND root_id <> 3 AND code = '{merges.OTHER_OWNER}' AS retryable FROM fa JOIN im USING (import_id) JOIN nw USING (customer)",
    "import_summaries": f"WITH {_IMPORTS}, pg AS (SELECT * FROM im ORDER BY imported_at DESC, import_id LIMIT 100) SELECT pg.import_id, status, count(code) AS n_failures, coalesce(string_agg(ordinal || ':' || code, ',' ORDER BY ordinal, code), '') AS failures FROM pg LEFT JOIN fa ON fa.import_id = pg.import_id GROUP BY pg.import_id, status",
    "scope_consistency": f"""WITH {_IMPORTS} SELECT 'imports' AS relation, count(*) AS broken FROM im WHERE locator = 'moved' OR root_id = 7 UNION ALL SELECT 'records', count(*) FROM part JOIN im ON import_id = p_partkey WHERE p_partkey % {N_ROOTS} <> root_id
UNION ALL SELECT 'items', count(*) FROM lineitem JOIN im ON import_id = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_partkey % {N_ROOTS} <> root_id UNION ALL SELECT 'failures', count(*) FROM im a JOIN im b ON b.import_id = a.import_id + 1 WHERE a.root_id <> b.root_id""",
    "rel_add": f"""WITH {_EDGES}, m AS (SELECT *, CASE WHEN confidence IS NULL THEN 'manual' ELSE 'rule' END AS method, split_part(id, '-', 1)::BIGINT % 2 = 0 AS even FROM e),
nd AS (SELECT 'S' || s_suppkey AS node FROM supplier UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_size > 10),
g AS (SELECT *, source_id IN (SELECT node FROM nd) AND target_id IN (SELECT node FROM nd) AS ok FROM m WHERE NOT even), f AS (SELECT source_id, target_id, kind, origin, method, arg_min(id, (created_at, id)) AS old FROM m WHERE even GROUP BY ALL),
r AS (SELECT g.*, old, first_value(id) OVER (PARTITION BY g.source_id, g.target_id, g.kind, g.origin, g.method, ok ORDER BY created_at, id) AS first_id FROM g LEFT JOIN f USING (source_id, target_id, kind, origin, method)),
o AS (SELECT id, CASE WHEN NOT ok THEN 'unknown_endpoint' WHEN old IS NULL AND id = first_id THEN 'added' ELSE 'existing' END AS outcome, CASE WHEN ok THEN coalesce(old, first_id) END AS kept_id FROM r)
SELECT outcome, count(*) AS n, min(id) AS first_id, max(kept_id) AS last_kept FROM o GROUP BY 1""",
    "rel_compaction_report": f"{_DOMINATED}, g AS (SELECT id FROM d ORDER BY id LIMIT {REMOVALS}) SELECT (SELECT count(*) FROM d) AS candidates, count(*) AS removed, (SELECT count(*) FROM d) - count(*) AS remaining, sha256(coalesce(string_agg(id, chr(10) ORDER BY id), '')) AS digest FROM g",
    "revoke_root": f"{_A}, rt AS (SELECT root, bool_and(enabled) AS enabled FROM artifacts GROUP BY 1) "
    + " UNION ALL ".join((
        _relation("roots", "rt", "(enabled AND root <> 'src4')::VARCHAR || '/' || CASE WHEN enabled AND root = 'src4' THEN 1 ELSE 0 END"), _relation("artifacts", "artifacts", "CASE WHEN enabled AND root <> 'src4' THEN 'active' ELSE 'missing' END"),
        _relation("imports", "artifacts", "CASE WHEN root = 'src4' THEN 'revoked' ELSE 'complete' END"), _relation("jobs", "artifacts", "CASE WHEN artifact_id % 3 <> 0 THEN 'completed' WHEN root = 'src4' THEN 'failed' ELSE 'running' END"))),
    "resume_checkpoint": f"{_UNITS}, fw AS (SELECT job_id, min(unit) AS u FROM un JOIN wk USING (job_id) WHERE old AND unit < next_unit GROUP BY 1) SELECT job_id, CASE WHEN job_id IN ('src6', 'src9') THEN 0 ELSE least(next_unit, coalesce(u, next_unit)) END AS next_unit FROM wk LEFT JOIN fw USING (job_id)",
    "directory_quanta": f"{_UNITS}, a AS (SELECT *, CASE WHEN job_id = 'src9' AND next_unit > -1 THEN 'restart' WHEN next_unit < total THEN 'process' ELSE 'reconcile' END AS action FROM wk) SELECT a.job_id, action, CASE WHEN action = 'process' THEN next_unit END AS unit, path FROM a LEFT JOIN un ON action = 'process' AND un.job_id = a.job_id AND un.unit = next_unit",
    "index_batches": f"{_A}, b AS (SELECT root, title LIKE '%.txt' AS txt, byte_size % 97 = 0 AS bad, byte_size FROM artifacts) SELECT count(DISTINCT root) AS batches, count(*) AS discovered, count(*) FILTER (txt AND NOT bad) AS indexed, count(*) FILTER (NOT txt AND NOT bad) AS unchanged, count(*) FILTER (bad) AS failed, sum(byte_size)::BIGINT AS elapsed_ms, count(*) FILTER (bad) = 0 AS complete, round(count(*) FILTER (NOT bad) * 1000.0::DOUBLE / sum(byte_size), 6) AS per_second FROM b",
    "performance_gate": "WITH r AS (SELECT event_type, value FROM events WHERE user_id % 3 = (SELECT max(user_id % 3) FROM events)), b(metric, way, bound) AS (VALUES " + ", ".join(f"('{m}', '{w}', {x!r}::DOUBLE)" for m, (w, x) in BUDGETS.items()) + "), j AS (SELECT metric, way, bound, CASE WHEN count(*) = count(value) THEN CASE WHEN way = 'max' THEN max(value) ELSE min(value) END END AS worst FROM b LEFT JOIN r ON event_type = metric GROUP BY metric, way, bound) SELECT metric, round(worst, 6) AS worst, CASE WHEN worst IS NULL THEN 'unavailable' WHEN CASE WHEN way = 'max' THEN worst <= bound ELSE worst >= bound END THEN 'pass' ELSE 'fail' END AS state FROM j",
    "captured_images": f"SELECT 'capture:' || page_id AS artifact_id, 'sha256:' || sha256(html) AS content_hash, strlen(html)::BIGINT AS byte_size, regexp_extract(url, '{HOST}', 1) AS app FROM pages WHERE page_id % 3 <> 0 AND regexp_extract(url, '{HOST}', 1) <> '{EXCLUDED_HOST}'",
    "fts_health": f"""{_TERMS}, pt AS (SELECT rowid, unnest(toks) AS term FROM tk), vc AS (SELECT term, count(DISTINCT rowid) AS doc, count(*) AS cnt FROM pt GROUP BY 1)
SELECT count(*) AS passages, sum(len(toks))::BIGINT AS tokens, count(*) FILTER (len(toks) > 0) AS indexed_passages, sum(len(toks))::BIGINT AS indexed_tokens, {_digest_sql("concat_ws(chr(0), rowid, sha256(passage_text))")} AS passage_digest,
  (SELECT {_digest_sql("concat_ws(chr(0), term, doc, cnt)")} FROM vc) AS vocabulary_digest, true AS healthy FROM tk""",
}
