"""Merges of the store, generations, cancellation, replay ledgers and reconciles against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import jobs, merges
from lodestone.plans import generations
from lodestone.streaming import events as E

EDGE = "id string, source_id string, target_id string, kind string, origin string, method string, created_at long"


def added(stored, incoming, nodes, cap):
    """Edges one after the other in the order of (created_at, id)."""
    key = lambda e: e[1:6]
    kept, degree, out = {}, {}, {}

    def put(e):
        kept[key(e)] = e[0]
        for n in {e[1], e[2]}:
            degree[n] = degree.get(n, 0) + 1

    for e in sorted(stored, key=lambda e: (e[6], e[0])):
        put(e)
    for e in sorted(incoming, key=lambda e: (e[6], e[0])):
        if not {e[1], e[2]} <= nodes:
            out[e[0]] = ("unknown_endpoint", None)
        elif key(e) in kept:
            out[e[0]] = ("existing", kept[key(e)])
        elif any(degree.get(n, 0) >= cap for n in (e[1], e[2])):
            out[e[0]] = ("degree_cap", None)
        else:
            put(e)
            out[e[0]] = ("added", e[0])
    return out


@pytest.mark.parametrize("cap", [3, 10_000])
def test_relationships_against_plain_python(spark, cap):
    r = random.Random(cap)
    edge = lambda i: (f"e{i}", f"n{r.randrange(9)}", f"n{r.randrange(9)}", "mentions", "observed", "rule", r.randrange(50))
    stored = list({e[1:6]: e for e in (edge(i) for i in range(8))}.values())
    incoming = list({e[1:6]: e for e in (edge(100 + i) for i in range(60))}.values())  # keys once: a refused key is not asked again
    incoming.append(("again", *stored[0][1:]))
    nodes = {f"n{i}" for i in range(8)}
    frames = [spark.createDataFrame(x, EDGE) for x in (stored, incoming)]
    got = merges.add_relationships(*frames, spark.createDataFrame([(n,) for n in nodes], "node string"), cap)
    assert {x["id"]: (x["outcome"], x["kept_id"]) for x in got.collect()} == added(stored, incoming, nodes, cap)


def test_bookmark_import(spark):
    stored = spark.createDataFrame([("u", "f", "1", "a"), ("v", "f", "1", "b")], "url string, folder string, entry string, owner string")
    rows = [(0, "u", "f", "1"), (1, "u", "f", "2"), (2, "u", "f", "2"), (3, "u", "g", "1"), (4, "v", "f", "1"), (5, "v", "h", "1"), (6, "w", "f", "1"), (7, "w", "g", "1"), (8, "w", "f", "1")]
    incoming = spark.createDataFrame([(*r, "a") for r in rows], "ordinal long, url string, folder string, entry string, owner string")
    got = [r["outcome"] for r in merges.merge_bookmarks(stored, incoming).orderBy("ordinal").collect()]
    assert got == ["unchanged", "merged", "unchanged", "conflict", merges.OTHER_OWNER, merges.OTHER_OWNER, "imported", "conflict", "unchanged"]
    hashes = spark.sql("select * from values ('t', null, ''), ('t', '', null), ('t', null, null) as (a, b, c)").select(merges.entry_hash(F.col("a"), F.col("b"), F.col("c")).alias("h"))
    assert hashes.distinct().count() == 3


def test_versions(spark):
    schema = "artifact_id long, content_hash string, extractor string, extractor_version string"
    stored = spark.createDataFrame([(1, "h1", "t", "1", "v1", True, "ready"), (1, "h0", "t", "1", "v0", False, "superseded"), (2, "h", "t", "1", "v2", True, "ready"), (3, "h", "t", "1", "v3", True, "ready")], schema + ", version_id string, active boolean, state string")
    merged = merges.upsert_versions(stored, spark.createDataFrame([(1, "h0", "t", "1"), (2, "h", "t", "2"), (4, "x", "t", "1")], schema))
    assert {r["artifact_id"]: r["outcome"] for r in merged.collect()} == {1: "reused", 2: "updated", 3: "missing", 4: "inserted"}
    after = {r["version_id"]: (r["state"], r["active"]) for r in merges.superseded(stored, merged).collect()}
    assert after == {"v1": ("superseded", False), "v0": ("ready", True), "v2": ("superseded", False), "v3": ("ready", True)}
    empty = stored.limit(0)
    assert merges.upsert_versions(empty, empty).count() == 0


def test_purge_revoke_and_capture(spark):
    gone = spark.createDataFrame([("a",)], "artifact_id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source_id string, target_id string")
    assert [tuple(r) for r in merges.purged(gone, {"edges": (e, ["source_id", "target_id"])})["edges"].collect()] == [("b", "c")]
    roots = spark.createDataFrame([("r", True, 4), ("s", True, 0)], "root_id string, enabled boolean, generation int")
    rows = spark.createDataFrame([("r", "active"), ("s", "active")], "root_id string, state string")
    work = spark.createDataFrame([("r", "running"), ("r", "queued")], "root_id string, state string")
    out = merges.revoke("r", roots, rows, rows.withColumnRenamed("state", "status"), work)
    assert sorted(map(tuple, out["roots"].collect())) == [("r", False, 5), ("s", True, 0)]
    assert merges.revoke("r", out["roots"], rows, rows.withColumnRenamed("state", "status"), work)["roots"].where("root_id = 'r'").first()["generation"] == 5
    assert sorted(r["state"] for r in out["jobs"].collect()) == ["failed", "queued"]
    images = spark.createDataFrame([(1, "image/png", bytearray(b"x"), "ok", "w", "u", 1), (2, "image/png", bytearray(b"x"), "bank", "w", "u", 1), (3, "text/html", bytearray(b"x"), "ok", "w", "u", 1)], "image_id long, media_type string, bytes binary, app string, window_title string, url string, captured_at long")
    bank = spark.createDataFrame([("bank",)], "app string")
    assert [r["artifact_id"] for r in merges.captured_images(images, False, bank).collect()] == ["capture:1"]
    assert merges.captured_images(images, True, bank).count() == 0


def test_digests_do_not_depend_on_order_and_see_changes(spark):
    v = [("a", 1, 2), ("b", 1, 1), ("c", 3, 9)]
    of = lambda rows: merges.vocabulary_digest(spark.createDataFrame(rows, "term string, doc long, cnt long")).first()["digest"]
    assert of(v) == of(v[::-1]) and of(v) != of(v[:2]) and of(v) != of([("a", 2, 2), *v[1:]]) and len(of(v).split()) == 4
    assert of(v) != of([*v, v[0], v[0]]) and of([v[0], v[0]]) != of([v[1], v[1]])  # equal rows do not cancel
    empty = merges.vocabulary_digest(spark.createDataFrame([], "term string, doc long, cnt long")).first()["digest"]
    assert empty == " ".join(["0" * 15 + "+0"] * 4)


def test_resume_and_quanta(spark):
    files = spark.createDataFrame([(j, u, f"p{u}", "x" if (j, u) == (2, 1) else "h", "h", "f") for j in (1, 2, 3) for u in range(4)], "job_id long, unit long, path string, stored_hash string, hash string, fingerprint string")
    work = spark.createDataFrame([(1, "interrupted", 3, 4, "f"), (2, "running", 3, 4, "f"), (3, "running", 4, 4, "f"), (4, "running", 1, 4, "f"), (5, "queued", 0, 0, "f")], "job_id long, state string, next_unit long, total long, fingerprint string")
    assert {r["job_id"]: r["next_unit"] for r in merges.resume(work, files).collect()} == {1: 3, 2: 1, 3: 4, 4: 0, 5: 0}
    got = {r["job_id"]: (r["action"], r["unit"], r["path"]) for r in jobs.directory_quanta(work, files).collect()}
    assert got == {1: ("process", 3, "p3"), 2: ("process", 3, "p3"), 3: ("reconcile", None, None), 4: ("restart", None, None), 5: ("reconcile", None, None)}


def test_budgets_and_totals(spark):
    runs = spark.createDataFrame([(1, "a", 9.0), (2, "a", 1.0), (2, "a", 3.0), (2, "b", None), (2, "c", 5.0)], "scale int, metric string, value double")
    got = {r["metric"]: (r["worst"], r["state"]) for r in merges.budget_gate(runs, {"a": ("max", 2.0), "b": ("max", 1.0), "c": ("min", 5.0), "d": ("max", 1.0)}).collect()}
    assert got == {"a": (3.0, "fail"), "b": (None, "unavailable"), "c": (5.0, "pass"), "d": (None, "unavailable")}
    b = spark.createDataFrame([(5, 3, 2, 0, 100), (4, 2, 2, 0, 300)], "discovered long, indexed long, unchanged long, failed long, elapsed_ms long")
    t = merges.batch_totals(b).first()
    assert t["complete"] and t["per_second"] == 22.5
    assert merges.batch_totals(b.limit(0)).first()["per_second"] is None


def test_generations(spark, tmp_path):
    path = str(tmp_path / "g")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, hash string")
    assert generations.current(spark, path, "s1") is None
    generations.publish(df, path, "s1")
    first = generations.current(spark, path, "s1")
    generations.publish(df.where("id = 1"), path, "s2")
    assert first.count() == 2, "readers of the old generation keep it"
    assert generations.current(spark, path, "s1") is None and generations.current(spark, path, "s2").count() == 1
    assert generations.pointer(spark, path)["rows"] == 1
    now = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "id long, hash string")
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x")], "id long, hash string")
    assert sorted(map(tuple, generations.invalid(old, now).collect())) == [(2, "changed"), (3, "gone"), (4, "absent")]
    generations.drop(spark, path)
    assert generations.pointer(spark, path) is None


def test_cancellation(spark):
    token, seen = generations.Cancellation(spark), []
    assert token.run([lambda: spark.range(3).count()]) == [3]

    def stop():
        seen.append(1)
        token.cancel()

    with pytest.raises(generations.Cancelled, match="after 1"):
        token.run([stop, lambda: seen.append(2)])
    assert seen == [1]


LEDGER = "ledger string, session string, counter long, request_id string, intent string, at_us long, seq long"


def requests(n, seed=1):
    r = random.Random(seed)
    return [(f"l{r.randrange(2)}", f"s{r.randrange(3)}", r.randrange(60), f"r{r.randrange(80)}", f"i{r.randrange(90)}", 10_000_000 * (i + 1), i) for i in range(n)]


def test_replay_ledger(spark, tmp_path):
    rows = requests(60)
    books, want = {}, {}
    for ledger, session, counter, request, intent, at, seq in rows:
        b = books.setdefault(ledger, {"last": {}, "seen": set(), "at": []})
        recent = [t for t in b["at"] if t + 60_000_000 > at]
        if counter <= b["last"].get(session, -1) or ("r", request) in b["seen"] or ("i", intent) in b["seen"]:
            want[seq] = "replay"
        elif len(recent) >= 2:
            want[seq] = "rate_limited"
        else:
            b["last"][session] = counter
            b["seen"] |= {("r", request), ("i", intent)}
            b["at"].append(at)
            want[seq] = "accept"
    assert set(want.values()) == {"accept", "replay", "rate_limited"}
    df = spark.createDataFrame(rows, LEDGER)
    assert {r["seq"]: r["decision"] for r in E.replay_ledger(df, 2).collect()} == want
    for i, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, LEDGER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = E.replay_stream(spark.readStream.schema(LEDGER).parquet(f"{tmp_path}/in"), 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert {r["seq"]: r["decision"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_ledger_forgets():
    book = E.Ledger(10**9)
    assert book.decide("s", 5, "r", "i", 0) == "accept" and book.decide("s", 5, "q", "j", 1) == "replay"
    assert book.decide("s", 1, "q", "j", E.SESSION_US) == "accept", "a session is forgotten after a day"
    for i in range(E.MAX_REMEMBERED):
        book.decide("t", i, f"x{i}", f"y{i}", E.SESSION_US)
    assert book.decide("u", 1, "r", "i", E.SESSION_US) == "accept", "the oldest ids are forgotten"
    assert E.Ledger(4, book.saved()).decide("v", 1, "x9", "new", E.SESSION_US) == "replay"


def test_reconciles(spark, tmp_path):
    schema = "artifact_id long, content_hash string, extractor string, extractor_version string, root_id string"
    stored = spark.createDataFrame([(1, "h", "t", "1", "r", "v1", True), (2, "h", "t", "1", "s", "v2", True)], schema + ", version_id string, active boolean")
    scan = spark.createDataFrame([(1, "g", "t", "1", "r")], schema)
    some = spark.createDataFrame([(1,)], "seq int")
    assert {r["artifact_id"]: r["outcome"] for r in E.reconciled(some, stored, scan).collect()} == {1: "updated", 2: "missing"}
    assert E.reconciled(some.limit(0), stored, scan).count() == 0
    roots = spark.createDataFrame([("r", True, "directory", "directory"), ("s", True, "directory", "absent"), ("t", False, "directory", "directory")], "root_id string, enabled boolean, kind string, probe string")
    got = {r["root_id"]: (r["failure"], r["updated"], r["missing"]) for r in E.startup(roots, stored, scan).collect()}
    assert got == {"r": (None, 1, 0), "s": ("missing", 0, 0)}, "artifacts of a root that is gone stay"
    some.write.parquet(f"{tmp_path}/ev")
    seen = []
    stream = spark.readStream.schema("seq int").parquet(f"{tmp_path}/ev")
    E.reconcile_stream(stream, lambda: stored, lambda: scan, lambda m, epoch: seen.append(m.count())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    assert seen == [2]
    (tmp_path / "files").mkdir()
    for name in "ab":
        (tmp_path / "files" / name).write_bytes(name.encode())
    units = []
    jobs.directory_stream(spark, f"{tmp_path}/files", lambda rows, epoch: units.append([bytes(r["content"]) for r in rows.select("content").collect()])).option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(units) == [[b"a"], [b"b"]]


def test_identical_bytes_reuse_an_import(spark):
    i = "import_id long, root_id int, locator string, content_hash string, imported_at long, status string"
    imports = spark.createDataFrame([(1, 0, "a", "h", 1, "complete"), (2, 0, "a", "h", 2, "complete"), (3, 0, "a", "g", 3, "revoked"), (4, 1, "b", "h", 1, "complete"), (5, 2, "c", "h", 9, "complete")], i)
    failures = spark.createDataFrame([(2, 0, merges.OTHER_OWNER), (4, 0, merges.OTHER_OWNER), (4, 1, "invalid_url"), (5, 0, merges.OTHER_OWNER)], "import_id long, ordinal long, code string")
    roots = spark.createDataFrame([(0, True), (1, True), (2, False)], "root_id int, enabled boolean")
    requests = spark.createDataFrame([(10, 0, "a", "h"), (11, 0, "a", "g"), (12, 1, "b", "h"), (13, 1, "a", "h"), (14, 2, "c", "h"), (12, 1, "b", "h")], "request_id long, root_id int, locator string, content_hash string")
    found = sorted(map(tuple, merges.import_requests(requests, imports, failures, roots).collect()))
    # a newer import of "a" has resolved the failure of import 2; a disabled root is not granted again
    assert found == [(10, "reused", 2, 0), (11, "new", None, 0), (12, "reused", 4, 1), (12, "reused", 4, 1), (13, "new", None, 0), (14, "reused", 5, 0)]
