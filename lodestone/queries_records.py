"""Registered queries on the graph, canonical records, HTML, images, events and captures, with their SQL.

Where the driver's tables lack something, plain rules stand in for it; they are given with each view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import geometry, html
from lodestone.operators import graph, records
from lodestone.plans import canonical as C
from lodestone.sources import capture
from lodestone.sources import bookmarks
from lodestone.streaming import events as E

HUB, REMOVALS, VERSIONS, MAX_EVENTS = "S3", 200, 5, 40
CUTOFF_DAY, DAYS = "1999-06-01", 400


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges from supplier to part: kind by line status, origin by return flag, confidence from the discount."""
    x = C.table(spark, sf_dir, "lineitem")
    origin = F.when(F.col("l_returnflag") == "A", "user_confirmed").when(F.col("l_returnflag") == "R", "observed").otherwise("inferred")
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"),
        F.concat(F.lit("S"), "l_suppkey").alias("source_id"), F.concat(F.lit("P"), "l_partkey").alias("target_id"), F.when(F.col("l_linestatus") == "O", "mentions").otherwise("duplicate_of").alias("kind"),
        origin.alias("origin"), F.when(origin == "inferred", F.col("l_discount") * 10).alias("confidence"), F.col("l_shipdate").alias("created_at"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.col("s_name").alias("name"))
    return s.union(C.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey"), "p_name"))


def rel_dedupe(spark, sf_dir):
    return graph.deduplicated(edges(spark, sf_dir)).select("source_id", "target_id", "kind", "origin", "id")


def rel_degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


def rel_listing(spark, sf_dir):
    return graph.listing(edges(spark, sf_dir), HUB, nodes(spark, sf_dir)).select("id", "source_id", "target_id", "kind", "origin", "source_name", "target_name")


def rel_compaction(spark, sf_dir):
    return graph.compaction(edges(spark, sf_dir), REMOVALS)


def rel_validation(spark, sf_dir):
    """Edges by what is wrong with them: a self edge, an inferred edge without confidence, a confidence out of 0 to 1."""
    e = edges(spark, sf_dir)
    wrong = F.concat_ws(";", F.when(F.col("source_id") == F.col("target_id"), "self_edge"), F.when((F.col("origin") == "inferred") & F.col("confidence").isNull(), "no_confidence"), F.when((F.col("confidence") < 0) | (F.col("confidence") > 0.75), "confidence_out_of_range"))
    return e.groupBy(wrong.alias("problems")).agg(F.count("*").alias("n"))


def version_history(spark, sf_dir):
    """Orders as versions of their customer; the current one is that of the highest price."""
    o = C.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artifact"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    top = F.row_number().over(Window.partitionBy("artifact").orderBy(F.col("o_totalprice").desc(), "version"))
    first = C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("version")).agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("first_passage"))
    h = graph.history(o.withColumn("current", top == 1), VERSIONS)
    return h.join(first, "version", "left").select("artifact", "version", "position", "current", "more", "first_passage")


def _stored(spark, sf_dir):
    return C.artifacts(spark, sf_dir).where("root <> 'src5'").select("artifact_id", "root", "content_hash")


def _incoming(spark, sf_dir):
    """The source as it is now: src3 is gone, French texts have changed, src5 is new."""
    a = C.artifacts(spark, sf_dir).where("root <> 'src3'")
    changed = F.when(F.endswith("title", F.lit(".txt")), F.concat(F.lit("sha256:"), F.sha2(F.concat("text", F.lit("\nmore")), 256))).otherwise(F.col("content_hash"))
    return a.select("artifact_id", changed.alias("content_hash"))


def reconcile_missing(spark, sf_dir):
    return records.missing(_stored(spark, sf_dir), _incoming(spark, sf_dir)).select("artifact_id", "root", "state")


def _bookmarks(spark, sf_dir):
    """Pages as bookmarks: folder by host, title from the page; the export knows https as http and files German pages under other."""
    p = C.table(spark, sf_dir, "pages")
    u = F.regexp_replace("url", "^https:", "http:")
    host, title = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("html", "<title>([^<]*)", 1)
    stored = p.where(F.startswith("url", F.lit("http:"))).groupBy(F.col("url"), host.alias("folder")).agg(F.min(title).alias("title"))
    incoming = p.select(F.col("page_id").alias("ordinal"), u.alias("url"), F.when(F.contains("url", F.lit("/de/")), "other").otherwise(host).alias("folder"), F.when(F.contains("url", F.lit("utm_")), F.concat(title, F.lit("!"))).otherwise(title).alias("title"))
    return stored, incoming


def bookmark_listing(spark, sf_dir):
    """Bookmark passages: title, url and folder as lines, and the hash of the entry."""
    _, i = _bookmarks(spark, sf_dir)
    return i.select("ordinal", F.sha2(F.concat_ws("\n", "title", "url", "folder"), 256).alias("passage_hash"), F.sha2(F.concat_ws("\x1f", "folder", "title", "url", F.lit(""), F.lit("")), 256).alias("entry_hash"))


def bookmark_parse(spark, sf_dir):
    """Each page's links as a bookmark export, parsed again."""
    p = C.table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('(<a href="[^"]*">[^<]*</a>)'), 1)
    body = F.concat(F.lit("<!DOCTYPE NETSCAPE-Bookmark-file-1><H1>x</H1><DL><DT><H3>Menu</H3><DL>"), F.array_join(F.transform(links, lambda x: F.replace(x, F.lit('href="/'), F.lit('HREF="http://h/'))), "<DT>"), F.lit("</DL></DL>"))
    return bookmarks.parse_exports(p.select("page_id", body.alias("content")), "page_id", "content").select("source", "ordinal", "folder_path", "title", "url", "failure_code")


def evidence_requests(spark, sf_dir):
    """Requests for all passages; those of src2 name an old content."""
    p = C.passages(spark, sf_dir)
    old = F.when(F.col("root") == "src2", "sha256:old").otherwise(F.col("content_hash"))
    return p.select("passage_id", old.alias("content_hash"), F.sha2("passage_text", 256).alias("text_hash"))


def _current(spark, sf_dir):
    return C.active(C.passages(spark, sf_dir)).select("passage_id", "content_hash", F.sha2("passage_text", 256).alias("text_hash"))


def evidence_verify(spark, sf_dir):
    return records.verified(evidence_requests(spark, sf_dir), _current(spark, sf_dir)).select("passage_id")


def evidence_stale(spark, sf_dir):
    return records.stale(evidence_requests(spark, sf_dir), _current(spark, sf_dir)).select("passage_id", F.lit("stale").alias("status"))


def purge_before(spark, sf_dir):
    """Customers whose first order is before the cutoff go with their orders and line items."""
    gone = C.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("artifact_id")).agg(F.min("o_orderdate").alias("d")).where(F.col("d") < F.lit(CUTOFF_DAY).cast("timestamp_ntz")).select("artifact_id")
    o = C.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    items = C.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_linenumber")
    return records.purge_counts(gone, {"orders": (o, ["o_custkey"]), "lineitem": (items, ["o_custkey"])})


def retention_cutoff(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders")
    last = o.agg((F.max("o_orderdate") - F.expr(f"make_interval(0, 0, 0, {DAYS})")).alias("cutoff"))
    return o.crossJoin(F.broadcast(last)).where("o_orderdate < cutoff").groupBy("o_orderstatus").agg(F.count("*").alias("expired"))  # one row


def library_stats(spark, sf_dir):
    a, p = C.artifacts(spark, sf_dir), C.passages(spark, sf_dir)
    x = a.agg(F.count("*").alias("artifacts"), F.count_if("enabled").alias("active"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"), F.count_distinct("root").alias("roots"))
    return x.crossJoin(p.agg(F.count("*").alias("passages"), F.sum(F.octet_length("passage_text")).alias("passage_bytes")))  # one row each


def storage_by_root(spark, sf_dir):
    return C.artifacts(spark, sf_dir).groupBy("root").agg(F.sum("byte_size").alias("bytes"), F.count_distinct("content_hash").alias("contents"))


def storage_rollup(spark, sf_dir):
    """Bytes by class: sources and records are canonical, passages derived, pages' HTML disposable."""
    a = C.artifacts(spark, sf_dir).agg(F.sum("byte_size").alias("b")).select(F.lit("canonical").alias("class"), "b")
    p = C.passages(spark, sf_dir).agg(F.sum(F.octet_length("passage_text")).alias("b")).select(F.lit("derived").alias("class"), "b")
    h = C.table(spark, sf_dir, "pages").agg(F.sum(F.octet_length("html")).alias("b")).select(F.lit("disposable").alias("class"), "b")
    rows = a.union(p).union(h)
    return rows.union(rows.agg(F.sum("b").alias("b")).select(F.lit("total").alias("class"), "b")).select("class", F.coalesce("b", F.lit(0)).alias("bytes"))


def portable_digest(spark, sf_dir):
    a = C.artifacts(spark, sf_dir).select("artifact_id", F.sha2(F.concat_ws("\x00", "artifact_id", "title", "content_hash"), 256).alias("h"))
    return records.digest_tree(a, "artifact_id", "h")


def inspect_source(spark, sf_dir):
    """Passage hashes in order of each active artifact, as one digest."""
    p = C.active(C.passages(spark, sf_dir)).select("artifact_id", F.struct("ordinal", F.sha2("passage_text", 256).alias("h")).alias("x"))
    return p.groupBy("artifact_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("artifact_id", F.size("x").cast("long").alias("passages"), F.sha2(F.array_join(F.transform("x", lambda s: s["h"]), ","), 256).alias("digest"))


def html_sanitize(spark, sf_dir):
    p = C.spread(C.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html.sanitize(F.col("html")).alias("x"))
    return p.select("page_id", F.sha2("x", 256).alias("digest"), F.length("x").alias("n"))


def html_untrusted(spark, sf_dir):
    p = C.table(spark, sf_dir, "pages")
    clean = html.sanitize(F.col("html"))
    return p.select("page_id", html.untrusted(F.col("html")).alias("raw_untrusted"), html.untrusted(clean).alias("clean_untrusted"))


def url_validation(spark, sf_dir):
    p = C.table(spark, sf_dir, "pages")
    odd = F.when(F.contains("url", F.lit("/de/")), F.concat(F.lit("javascript:"), "url")).when(F.contains("url", F.lit("/fr/")), F.replace("url", F.lit("://"), F.lit("//"))).when(F.contains("url", F.lit("/es/")), F.concat(F.lit("my_app:"), "url")).otherwise(F.col("url"))
    return p.select("page_id", F.coalesce(html.url_problem(odd), F.lit("ok")).alias("verdict"))


def media_types(spark, sf_dir):
    p = C.table(spark, sf_dir, "pages")
    return p.select(F.coalesce(html.media_type(F.concat("url", F.lit(".MD"))), F.lit("none")).alias("with_md"), F.coalesce(html.media_type(F.col("url")), F.lit("none")).alias("plain")).groupBy("with_md", "plain").agg(F.count("*").alias("n"))


def text_checks(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(html.text_problem(F.col("text")), F.lit("ok")).alias("verdict"), html.compact_path(F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/document-"), "doc_id", F.lit(".md"))).alias("path"))


def ocr_geometry(spark, sf_dir):
    """Line items as image regions: position from discount and tax, size from quantity, orientation from the line number."""
    x = C.table(spark, sf_dir, "lineitem")
    w, h = (F.lit(800) + F.col("l_partkey")).cast("int"), (F.lit(400) + F.col("l_suppkey")).cast("int")
    b = geometry.pixel_bounds(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.col("l_quantity") / 200, w, h, F.col("l_linenumber"))
    r = x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", b.alias("b"), F.round(F.col("l_discount") * 10000).cast("int").alias("c"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.x", "b.y", "b.width", "b.height", geometry.scaled_milli(F.col("b.width"), F.col("c")).alias("scaled_width"), geometry.confirmation(F.col("c")).alias("confirmation"))


def ocr_counts(spark, sf_dir):
    r = ocr_geometry(spark, sf_dir)
    return r.groupBy("confirmation").agg(F.count("*").alias("regions"), F.count_distinct("l_partkey").alias("images"))


def image_projection(spark, sf_dir):
    r = ocr_geometry(spark, sf_dir)
    p = geometry.projected(F.lit(10) + F.col("l_suppkey"), F.lit(20), F.lit(30), F.lit(40), F.lit(800) + F.col("l_partkey"), F.lit(2000), F.col("l_linenumber"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p.alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round(f"p.{c}", 6).alias(c) for c in ("left", "top", "width", "height")))


def running_offsets(spark, sf_dir):
    """Turns as regions of one text joined by line feeds: character range and line of each."""
    c = C.table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    line = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.select("conv_id", "turn", start.alias("char_start"), (start + F.length("text")).alias("char_end"), line.cast("long").alias("line"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file observations: 97 batches a day by user, a path a user."""
    e = C.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "created").when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "signup", "renamed").otherwise("modified")
    path = F.concat(F.lit("u"), "user_id")
    return e.select(F.concat_ws("/", F.to_date("ts").cast("string"), F.col("user_id") % 97).alias("batch"), F.struct("ts", "event_id").alias("seq"), kind.alias("kind"), F.when(kind == "renamed", F.concat(path, F.lit("-new"))).otherwise(path).alias("path"), F.when(kind == "renamed", path).alias("previous_path"))


def event_coalesce(spark, sf_dir):
    return E.coalesce(observations(spark, sf_dir), MAX_EVENTS)


def event_plans(spark, sf_dir):
    return E.plans(observations(spark, sf_dir), MAX_EVENTS)


def rate_limit(spark, sf_dir):
    """At most four accepted events of a user in a day."""
    e = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("seq"))
    return E.rate_limit(e, 4, 86_400_000_000)


def replay_filter(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    r = e.select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").alias("counter"), "event_id", F.col("event_id").alias("request_id"))
    return E.replay(r).select("event_id", "decision")


def late_rejection(spark, sf_dir):
    """Events against their user's latest: sessions of ten days, intents within two."""
    e = C.table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    now = F.max("at").over(Window.partitionBy("user_id"))
    day = 86_400_000_000
    return e.select("event_id", F.coalesce(E.capture_time(F.col("at"), F.col("at") + 10 * day, F.col("at"), now, 2 * day), F.lit("ok")).alias("verdict"))


def lifecycle_fold(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    event = F.create_map(*(F.lit(x) for x in ("view", "accept", "click", "revoke", "error", "repair", "signup", "expire", "purchase", "delete")))
    return E.lifecycle(e.select(F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("capture"), F.struct("ts", "event_id").alias("seq"), F.element_at(event, F.col("event_type")).alias("event")))


def job_claim_order(spark, sf_dir):
    """Orders as jobs of their customer's queue; priority from the order's."""
    o = C.table(spark, sf_dir, "orders")
    return E.claim_order(o.select(F.col("o_custkey").alias("queue"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderkey").alias("sequence")))


def job_listing(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders")
    return o.orderBy(F.col("o_orderkey").desc()).limit(100).select("o_orderkey", "o_orderstatus")


def job_states(spark, sf_dir):
    return C.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("queue")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count("*").alias("n"))


#: Fields of a capture's envelope.
ENVELOPE = ("protocol", "type", "request_id", "source")


def capture_fields(spark, sf_dir):
    """Envelopes of events against the fields that one must have and may have: errors lack their source, sign-ups carry cookies, and of views every
    tenth is no object."""
    e = C.table(spark, sf_dir, "events")
    kind, source = F.col("event_type"), F.when(F.col("event_type") != "error", F.col("props"))
    cookies = F.when(kind == "signup", F.lit("c"))
    body = F.to_json(F.struct(F.lit("1.0").alias("protocol"), kind.alias("type"), F.col("event_id").cast("string").alias("request_id"), source.alias("source"), cookies.alias("cookies")))
    body = F.when((kind == "view") & (F.col("event_id") % 10 == 0), F.lit("[1]")).otherwise(body)
    problem = capture.field_problem(body, list(ENVELOPE), list(ENVELOPE))
    return e.select("event_type", F.coalesce(problem, F.lit("ok")).alias("verdict")).groupBy("event_type", "verdict").agg(F.count("*").alias("n"))


def performance_corpus(spark, sf_dir):
    """Ten thousand synthetic artifacts: four-line bodies with a marker; every fifth is plain text."""
    i = spark.range(10_000)
    body = F.concat(F.lit("# Artifact "), "id", F.lit("\n"), F.format_string("performance-%06d", "id"), F.lit("\nbody\n"))
    return i.select(F.concat(F.format_string("%06d", "id"), F.when((F.col("id") + 20260824) % 5 == 0, ".txt").otherwise(".md")).alias("path"), F.sha2(body, 256).alias("digest"))


def path_order(spark, sf_dir):
    """Component-wise order of the artifacts' addresses within their root."""
    a = C.artifacts(spark, sf_dir)
    w = Window.partitionBy("root").orderBy(F.split("source_uri", "/"))
    return a.select("source_uri", F.row_number().over(w).cast("long").alias("position"))


QUERIES = {
    f.__name__: f
    for f in (
        rel_dedupe, rel_degree, rel_listing, rel_compaction, rel_validation, version_history, reconcile_missing, bookmark_listing, bookmark_parse, 
        evidence_verify, evidence_stale, purge_before, retention_cutoff, library_stats, storage_by_root, storage_rollup, portable_digest, inspect_source, html_sanitize, html_untrusted, url_validation, media_types, text_checks,
        ocr_geometry, ocr_counts, image_projection, running_offsets, event_coalesce, event_plans, rate_limit, replay_filter, late_rejection, lifecycle_fold, job_claim_order, job_listing, job_states, capture_fields, performance_corpus, path_order,
    )
}
