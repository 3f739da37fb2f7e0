"""Merges of the evidence store: versions, bookmark imports, relationships, purges, revocation, resumes, index health.

Every function takes tables and gives tables; nothing is changed in place. What a caller keeps is written as a new snapshot
(`plans/generations.py`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import MAX_DEGREE, compaction, dominated
from lodestone.plans.storage import written

VERSION_KEY = ["artifact_id", "content_hash", "extractor", "extractor_version"]
EDGE_KEY = ["source_id", "target_id", "kind", "origin", "method"]
OTHER_OWNER = "owned_by_other_export"


def upsert_versions(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """versions: VERSION_KEY, version_id, active; incoming: VERSION_KEY, one row an artifact. artifact_id, outcome, version_id.

    The same hash, extractor and extractor version as the active one is unchanged; as an older one it is reused; else a
    version is inserted (first) or updated (further ones), and its id is a digest of its key. Artifacts that a complete
    scan does not show are missing. Null parts of a key equal nothing."""
    same = versions.groupBy(*VERSION_KEY).agg(F.bool_or("active").alias("current"), F.min("version_id").alias("own"))
    known = versions.groupBy("artifact_id").agg(F.lit(True).alias("known"))
    rows = incoming.select(*VERSION_KEY).join(same, VERSION_KEY, "left").join(known, "artifact_id", "left")
    outcome = F.when(F.col("current"), "unchanged").when(F.col("own").isNotNull(), "reused").when(F.col("known"), "updated").otherwise("inserted")
    fresh = F.sha2(F.concat_ws("\x1f", *VERSION_KEY), 256)
    rows = rows.select("artifact_id", outcome.alias("outcome"), F.coalesce("own", fresh).alias("version_id"))
    gone = versions.where("active").join(incoming.select("artifact_id"), "artifact_id", "left_anti").select("artifact_id")
    return rows.union(gone.select("artifact_id", F.lit("missing"), F.lit(None).cast("string")))


def superseded(versions: DataFrame, merged: DataFrame) -> DataFrame:
    """The stored versions after `upsert_versions`: the chosen one is ready and active, other ready ones of an artifact that
    got another version are superseded; artifacts without a change keep their states."""
    changed = merged.where("outcome in ('reused', 'updated')").select("artifact_id", F.col("version_id").alias("chosen"))
    rows = versions.join(changed, "artifact_id", "left")
    mine = F.col("version_id") == F.col("chosen")
    state = F.when(F.col("chosen").isNull(), F.col("state")).when(mine, "ready").when(F.col("state") == "ready", "superseded").otherwise(F.col("state"))
    active = F.when(F.col("chosen").isNull(), F.col("active")).otherwise(mine)
    return rows.withColumns({"state": state, "active": active}).drop("chosen")


def entry_hash(title: Column, added_at: Column, modified_at: Column) -> Column:
    """What must be equal for a bookmark to be unchanged; a missing date differs from an empty one."""
    return F.sha2(F.to_json(F.struct(title.alias("t"), added_at.alias("a"), modified_at.alias("m"))), 256)


def merge_bookmarks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored: url, folder, entry, owner, one row a (url, folder); incoming: ordinal, url, folder, entry, owner (one import has
    one owner). ordinal, url, folder, outcome.

    A url that another owner holds fails as OTHER_OWNER. Else a known (url, folder) is unchanged or, where the entry
    differs from what is stored or an earlier record left, merged; a new one is a conflict if the url is known in
    another folder, stored or earlier in the import, else imported."""
    key = Window.partitionBy("url", "folder").orderBy("ordinal")
    before = Window.partitionBy("url").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = incoming.withColumns({"nth": F.row_number().over(key), "left": F.lag("entry").over(key)})
    rows = rows.withColumn("elsewhere", F.count("*").over(before) - (F.col("nth") - 1))
    own = stored.select("url", "folder", F.col("entry").alias("stored_entry"))
    held = stored.groupBy("url").agg(F.min("owner").alias("owner_a"), F.max("owner").alias("owner_z"))
    rows = rows.join(own, ["url", "folder"], "left").join(held, "url", "left")
    foreign = (F.col("owner_a") != F.col("owner")) | (F.col("owner_z") != F.col("owner"))
    exists = (F.col("nth") > 1) | F.col("stored_entry").isNotNull()
    same = F.coalesce("left", "stored_entry") == F.col("entry")
    known = (F.col("elsewhere") > 0) | F.col("owner_a").isNotNull()
    outcome = F.when(foreign, OTHER_OWNER).when(exists & same, "unchanged").when(exists, "merged").when(known, "conflict").otherwise("imported")
    return rows.select("ordinal", "url", "folder", outcome.alias("outcome"))


def failure_states(imports: DataFrame, failures: DataFrame, roots: DataFrame) -> DataFrame:
    """imports: import_id, root_id, locator, imported_at, status; failures: import_id, ordinal, code; roots: root_id, enabled.

    import_id, ordinal, code, state, retryable: a newer import of the same locator resolves a failure; of the
    pending ones those held by another owner can be tried again while the import is not revoked and its root is enabled."""
    order = F.struct("imported_at", "import_id")
    newest = imports.groupBy("locator").agg(F.max(order)["import_id"].alias("newest"))
    i = imports.join(newest, "locator").join(roots.select("root_id", "enabled"), "root_id", "left")
    i = i.select("import_id", (F.col("newest") == F.col("import_id")).alias("latest"), (F.col("enabled") & (F.col("status") != "revoked")).alias("open"))
    state = F.when(F.col("latest"), "pending").otherwise("resolved")
    again = F.col("latest") & F.coalesce("open", F.lit(False)) & (F.col("code") == OTHER_OWNER)
    return failures.join(i, "import_id").select("import_id", "ordinal", "code", state.alias("state"), again.alias("retryable"))


def import_requests(requests: DataFrame, imports: DataFrame, failures: DataFrame, roots: DataFrame) -> DataFrame:
    """requests: request_id, root_id, locator, content_hash; imports also have content_hash. request_id, outcome (reused or new), import_id of the
    one that is used again (the newest with the same root, locator and bytes that is not revoked; null for new ones) and retried, how many of
    its failures are tried again: only pending ones that another owner held, as in `failure_states`. Repeated requests are answered one by one."""
    keys = ["root_id", "locator", "content_hash"]
    same = imports.where("status <> 'revoked'").groupBy(*keys).agg(F.max(F.struct("imported_at", "import_id"))["import_id"].alias("import_id"))
    found = requests.join(same, keys, "left")
    again = failure_states(imports, failures, roots).where("retryable").groupBy("import_id").agg(F.count("*").alias("retried"))
    out = found.join(again, "import_id", "left")
    return out.select("request_id", F.when(F.col("import_id").isNull(), "new").otherwise("reused").alias("outcome"), "import_id", F.coalesce("retried", F.lit(0)).alias("retried"))


def import_summaries(imports: DataFrame, failures: DataFrame, limit: int = 100) -> DataFrame:
    """The newest imports with their failures in order. The page is cut before failures are gathered."""
    page = imports.orderBy(F.col("imported_at").desc(), "import_id").limit(limit)
    rows = failures.join(F.broadcast(page.select("import_id")), "import_id", "left_semi")  # limit rows at most
    nested = rows.groupBy("import_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "code"))).alias("failures"))
    return page.join(nested, "import_id", "left").withColumn("failures", F.coalesce("failures", F.array().cast("array<struct<ordinal:bigint,code:string>>")))


def add_relationships(stored: DataFrame, incoming: DataFrame, nodes: DataFrame, cap: int = MAX_DEGREE) -> DataFrame:
    """stored, incoming: id, EDGE_KEY, created_at; nodes: node. incoming's id, outcome, kept_id.

    Edges whose ends are not both known are refused (`unknown_endpoint`); a key that is stored, or that an earlier
    incoming edge has, gives that edge (`existing`); others are added in the order of (created_at, id) as long as both
    ends have fewer than `cap` edges (`degree_cap`), refused ones not counted."""
    own = nodes.select("node").distinct()
    rows = incoming.select("id", *EDGE_KEY, "created_at")
    good = rows.join(own.withColumnRenamed("node", "source_id"), "source_id", "left_semi").join(own.withColumnRenamed("node", "target_id"), "target_id", "left_semi")
    bad = rows.join(good.select("id"), "id", "left_anti").select("id", F.lit("unknown_endpoint").alias("outcome"), F.lit(None).cast("string").alias("kept_id"))
    first = stored.groupBy(*EDGE_KEY).agg(F.min(F.struct("created_at", "id"))["id"].alias("old"))
    group = Window.partitionBy(*EDGE_KEY).orderBy("created_at", "id")
    good = good.join(first, EDGE_KEY, "left").withColumn("first_id", F.first("id").over(group))
    repeated = good.where("old is not null or id <> first_id")
    new = good.where("old is null and id = first_id").select("id", "source_id", "target_id", "created_at")
    refused = _over_cap(stored, new, cap)
    kept = new.select("id") if refused is None else new.select("id").join(refused, "id", "left_anti")
    out = bad.union(kept.select("id", F.lit("added"), F.col("id")))
    if refused is None:
        return out.union(repeated.select("id", F.lit("existing"), F.coalesce("old", "first_id")))
    capped = refused.select(F.col("id").alias("first_id"), F.lit(True).alias("capped"))
    repeated = repeated.join(capped, "first_id", "left")
    hit = F.col("capped") & F.col("old").isNull()
    out = out.union(refused.select("id", F.lit("degree_cap"), F.lit(None).cast("string")))
    return out.union(repeated.select("id", F.when(hit, "degree_cap").otherwise("existing"), F.when(~F.coalesce(hit, F.lit(False)), F.coalesce("old", "first_id"))))


def _ends(edges: DataFrame, *columns: str) -> DataFrame:
    return edges.select(*columns, F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node"))


def _over_cap(stored: DataFrame, new: DataFrame, cap: int) -> DataFrame | None:
    """The new edges that the cap refuses, or None. Only edges at nodes that could pass the cap are looked at.

    In each round an edge is settled: added if it is in the room of both ends even if all undecided edges before it
    are added, refused if an end is full with settled ones before it. The earliest undecided edge is always settled."""
    held = _ends(stored).groupBy("node").agg(F.count("*").alias("n"))
    wanted = _ends(new).groupBy("node").agg(F.count("*").alias("m"))
    room = wanted.join(held, "node", "left").select("node", "m", F.greatest(F.lit(cap) - F.coalesce("n", F.lit(0)), F.lit(0)).alias("room"))
    tight = written(room.where("m > room").select("node", "room"), "tight")
    if tight.isEmpty():
        return None
    todo = written(_ends(new, "id", "created_at").join(tight, "node").withColumn("added", F.lit(None).cast("boolean")), "ends")
    while True:
        w = Window.partitionBy("node").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
        sure = F.coalesce(F.count_if(F.col("added")).over(w), F.lit(0))
        maybe = F.coalesce(F.count_if(F.coalesce("added", F.lit(True))).over(w), F.lit(0))
        ends = todo.withColumns({"full": sure >= F.col("room"), "free": maybe < F.col("room")})
        settled = ends.groupBy("id").agg(F.bool_or("full").alias("full"), F.bool_and("free").alias("free"))
        settled = settled.select("id", F.when(F.col("full"), False).when(F.col("free"), True).alias("now"))
        todo = written(todo.join(settled, "id").withColumn("added", F.coalesce("added", "now")).drop("now"), "ends")
        if todo.where("added is null").isEmpty():
            return todo.where("not added").select("id").distinct()


def compaction_report(edges: DataFrame, max_removals: int) -> DataFrame:
    """candidates, removed, remaining and the digest of the removed ids in order (10,000 at most)."""
    gone = compaction(edges, max_removals)
    ids = gone.agg(F.count("*").alias("removed"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("digest"))
    n = dominated(edges).agg(F.count("*").alias("candidates"))
    return n.crossJoin(ids).select("candidates", "removed", (F.col("candidates") - F.col("removed")).alias("remaining"), "digest")  # one row each


def purged(gone: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """What is left of each child table when the artifacts in gone (artifact_id) go: rows none of whose key columns names one."""

    def rest(rows: DataFrame, keys: list[str]) -> DataFrame:
        return reduce(lambda r, k: r.join(gone.select(F.col("artifact_id").alias(k)), k, "left_anti"), keys, rows).select(*rows.columns)

    return {name: rest(rows, keys) for name, (rows, keys) in children.items()}


def revoke(root: str, roots: DataFrame, artifacts: DataFrame, imports: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """The four tables after a root is revoked: disabled with the next generation; its active artifacts missing, its
    imports revoked, its running jobs failed. Revoking twice changes the generation only once."""
    own = F.col("root_id") == root
    return {
        "roots": roots.withColumns({"generation": F.col("generation") + F.when(own & F.col("enabled"), 1).otherwise(0), "enabled": F.col("enabled") & ~own}),
        "artifacts": artifacts.withColumn("state", F.when(own & (F.col("state") == "active"), "missing").otherwise(F.col("state"))),
        "imports": imports.withColumn("status", F.when(own, "revoked").otherwise(F.col("status"))),
        "jobs": jobs.withColumn("state", F.when(own & (F.col("state") == "running"), "failed").otherwise(F.col("state"))),
    }


def root_status(roots: DataFrame) -> DataFrame:
    """roots: enabled, kind, probe (what the file system said: file, directory, symlink, absent, denied, or null)."""
    p = F.col("probe")
    status = F.when(~F.col("enabled"), "revoked").when(p == "symlink", "unsafe").when(p == "absent", "missing").when(p == "denied", "denied")
    return roots.withColumn("status", status.when(p == F.col("kind"), "available").when(p.isin("file", "directory"), "wrong_type").otherwise("unavailable"))


def scope_problems(roots: DataFrame, imports: DataFrame, records: DataFrame, items: DataFrame, failures: DataFrame) -> DataFrame:
    """relation, broken: rows whose import belongs to another root than what they refer to.

    roots: root_id, kind, locator; imports: import_id, root_id, locator; records: bookmark_id, root_id, first_import;
    items: import_id, bookmark_id; failures: import_id, resolved_by."""
    i = imports.select("import_id", F.col("root_id").alias("import_root"))
    r = records.select("bookmark_id", F.col("root_id").alias("own_root"))
    a = imports.join(roots.select("root_id", "kind", F.col("locator").alias("root_locator")), "root_id").where("locator <> root_locator or kind <> 'file'")
    b = records.join(i.withColumnRenamed("import_id", "first_import"), "first_import").where("root_id <> import_root")
    c = items.join(i, "import_id").join(r, "bookmark_id").where("own_root <> import_root")
    d = failures.join(i, "import_id").join(i.toDF("resolved_by", "later_root"), "resolved_by").where("later_root <> import_root")
    return reduce(DataFrame.union, (x.agg(F.count("*").alias("broken")).select(F.lit(n).alias("relation"), "broken") for n, x in (("imports", a), ("records", b), ("items", c), ("failures", d))))


def resume(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """jobs: job_id, state, next_unit, total, fingerprint; files: job_id, unit, stored_hash, hash, fingerprint (of the
    scan as it is now), one row a unit. job_id, next_unit.

    A running or interrupted job goes on if total and fingerprint are those of the scan; its completed units are
    compared again and it goes back to the first that differs. All others start at 0."""
    now = files.groupBy("job_id").agg(F.count("*").alias("units"), F.first("fingerprint").alias("scan"))
    wrong = files.join(jobs.select("job_id", "next_unit"), "job_id").where((F.col("unit") < F.col("next_unit")) & ~F.col("hash").eqNullSafe(F.col("stored_hash")))
    first = wrong.groupBy("job_id").agg(F.min("unit").alias("first_wrong"))
    rows = jobs.join(now, "job_id", "left").join(first, "job_id", "left")
    fits = F.col("state").isin("running", "interrupted") & (F.col("total") == F.col("units")) & (F.col("fingerprint") == F.col("scan"))
    return rows.select("job_id", F.when(F.coalesce(fits, F.lit(False)), F.least("next_unit", "first_wrong")).otherwise(F.lit(0)).cast("long").alias("next_unit"))


def set_digest(row_hash: Column) -> Column:
    """An aggregate: a digest of rows' SHA-256 hex digests that does not depend on their order: for each of four lanes of 60 bits the
    exclusive or and the exact sum, so that partial digests are merged before the exchange and equal rows do not cancel."""

    def lane(i: int) -> Column:
        value = F.conv(F.substring(row_hash, 1 + 15 * i, 15), 16, 10).cast("long")
        total = F.coalesce(F.sum(value.cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
        return F.concat(F.coalesce(F.lpad(F.lower(F.hex(F.bit_xor(value))), 15, "0"), F.lit("0" * 15)), F.lit("+"), total)

    return F.concat_ws(" ", *map(lane, range(4)))


def passage_row() -> Column:
    """The digest of one indexed passage (rowid, text_hash), for `set_digest`."""
    return F.sha2(F.concat_ws("\x00", F.col("rowid").cast("string"), "text_hash"), 256)


def vocabulary_digest(vocabulary: DataFrame) -> DataFrame:
    """vocabulary: term, doc, cnt. One digest of the terms with their counts."""
    return vocabulary.agg(set_digest(F.sha2(F.concat_ws("\x00", "term", F.col("doc").cast("string"), F.col("cnt").cast("string")), 256)).alias("digest"))


def batch_totals(batches: DataFrame) -> DataFrame:
    """batches: discovered, indexed, unchanged, failed, elapsed_ms. Totals, whether every discovered file is accounted for
    without a failure, and artifacts a second (null where no time has passed)."""
    names = ("discovered", "indexed", "unchanged", "failed", "elapsed_ms")
    t = batches.agg(F.count("*").alias("batches"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    done = F.col("indexed") + F.col("unchanged")
    return t.withColumns({"complete": (F.col("failed") == 0) & (done == F.col("discovered")), "per_second": F.when(F.col("elapsed_ms") > 0, done * 1000.0 / F.col("elapsed_ms"))})


def budget_gate(runs: DataFrame, budgets: dict[str, tuple[str, float]]) -> DataFrame:
    """runs: scale, metric, value; budgets: metric -> ("max" or "min", limit). metric, worst, state (pass, fail, unavailable).

    The worst value of the largest scale's runs decides; a metric without a value there is unavailable, not zero."""
    rows = runs.join(F.broadcast(runs.agg(F.max("scale").alias("scale"))), "scale", "left_semi")  # one row
    spark = runs.sparkSession
    limits = F.broadcast(spark.createDataFrame([(m, way, float(x)) for m, (way, x) in budgets.items()], "metric string, way string, bound double"))
    worst = rows.groupBy("metric").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.bool_or(F.col("value").isNull()).alias("gap"))
    j = limits.join(worst, "metric", "left").withColumn("worst", F.when(~F.col("gap"), F.when(F.col("way") == "max", F.col("hi")).otherwise(F.col("lo"))))
    ok = F.when(F.col("way") == "max", F.col("worst") <= F.col("bound")).otherwise(F.col("worst") >= F.col("bound"))
    return j.select("metric", "worst", F.when(F.col("worst").isNull(), "unavailable").when(ok, "pass").otherwise("fail").alias("state"))


def captured_images(images: DataFrame, policy_paused: bool, excluded: DataFrame) -> DataFrame:
    """images: image_id, media_type, bytes, app, window_title, url, captured_at. Intended screenshots as artifacts with their context;
    none while capturing is paused, none of an excluded app (excluded: app, a policy's list), images only."""
    rows = images.where(F.startswith("media_type", F.lit("image/")) & F.lit(not policy_paused)).join(F.broadcast(excluded.select("app")), "app", "left_anti")
    context = F.struct("app", "window_title", "url", "captured_at")
    return rows.select(F.concat(F.lit("capture:"), "image_id").alias("artifact_id"), "media_type", F.concat(F.lit("sha256:"), F.sha2("bytes", 256)).alias("content_hash"), F.octet_length("bytes").cast("long").alias("byte_size"), context.alias("context"))


def purge_extractor(versions: DataFrame, passages: DataFrame, extractor: str) -> tuple[DataFrame, DataFrame]:
    """Versions and passages (version_id) without what one extractor made; artifacts and locators stay as they are."""
    gone = versions.where(F.col("extractor") == extractor).select("version_id")
    return versions.where(~F.col("extractor").eqNullSafe(F.lit(extractor))), passages.join(gone, "version_id", "left_anti")


def active_evidence(artifacts: DataFrame, versions: DataFrame, roots: DataFrame, locators: DataFrame) -> DataFrame:
    """artifacts: artifact_id, state, active_version_id, root_id; versions: version_id, artifact_id; roots: root_id, enabled;
    locators: artifact_id, locator, active. artifact_id, version_id, locator of what searches may show: an active artifact's
    active version under an enabled root at each active locator."""
    a = artifacts.where("state = 'active'").select("artifact_id", F.col("active_version_id").alias("version_id"), "root_id")
    a = a.join(roots.where("enabled").select("root_id"), "root_id", "left_semi").join(versions.select("artifact_id", "version_id"), ["artifact_id", "version_id"], "left_semi")
    return a.join(locators.where("active").select("artifact_id", "locator"), "artifact_id").select("artifact_id", "version_id", "locator")


def evidence_at_endpoint(edges: DataFrame, passages: DataFrame) -> DataFrame:
    """edges: id, source_id, target_id, evidence_id; passages: passage_id, artifact_id. Edges whose evidence is a passage of one of their ends."""
    p = passages.select(F.col("passage_id").alias("evidence_id"), "artifact_id")
    at_end = (F.col("artifact_id") == F.col("source_id")) | (F.col("artifact_id") == F.col("target_id"))
    return edges.join(p, "evidence_id").where(at_end).select(*edges.columns)
