"""Cascades, digest-tree comparison, capture frames (batch and stream), keyed coalescing, bounded walks."""

import base64
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cascade, snapshots
from lodestone.operators.cascade import Reference
from lodestone.sources import files
from lodestone.streaming import captures, coalescing, events

# ---- cascades


def test_purge_follows_references_and_reports(spark):
    t = {
        "a": spark.createDataFrame([(1,), (2,), (3,), (None,)], "a_id int"),
        "v": spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, None)], "v_id int, a_id int"),
        "p": spark.createDataFrame([(100, 10), (101, 20), (102, 30)], "p_id int, v_id int"),
        "r": spark.createDataFrame([(1, 2, 3, 100), (2, 3, 1, 101), (3, 3, 2, None), (4, 2, 2, 101)], "r_id int, s int, t int, e int"),
        "other": spark.createDataFrame([(1,)], "o_id int"),
    }
    keys = {"r": "r_id", "p": "p_id", "v": "v_id", "a": "a_id", "other": "o_id"}
    refs = (Reference("v", "a_id", "a"), Reference("p", "v_id", "v"), Reference("r", "s", "a"), Reference("r", "t", "a"), Reference("r", "e", "p", clears=True))
    after, report = cascade.purge(t, keys, refs, {"a": spark.createDataFrame([(1,), (None,), (99,)], "a_id int")})
    rows = lambda n: sorted(map(tuple, after[n].collect()), key=repr)
    assert rows("a") == [(2,), (3,), (None,)] and rows("v") == [(20, 2), (30, None)] and rows("p") == [(101, 20), (102, 30)]
    assert rows("r") == [(1, 2, 3, None), (3, 3, 2, None), (4, 2, 2, 101)]
    assert {tuple(x) for x in report.collect()} == {("a", 1, 0, 3), ("v", 2, 0, 2), ("p", 1, 0, 2), ("r", 1, 1, 3), ("other", 0, 0, 1)}
    after, report = cascade.purge(t, keys, refs, {"p": spark.createDataFrame([(101,)], "p_id int")})
    assert after["r"].where("e is null").count() == 3 and report.where("relation = 'r'").first()["cleared"] == 2
    with pytest.raises(ValueError, match="circle"):
        cascade.order({"a": "x", "b": "y"}, (Reference("a", "i", "b"), Reference("b", "j", "a")))


# ---- snapshots


def test_differences_are_found_and_only_differing_branches_are_read(spark, tmp_path):
    rows = [(f"k{i}", f"h{i}") for i in range(3000)]
    changed = [(k, "new" if k in ("k5", "k77") else h) for k, h in rows if k != "k9"] + [("more", "x")]
    for name, r in (("a", rows), ("b", changed), ("c", rows), ("none", [])):
        snapshots.write_snapshot(spark.createDataFrame(r, "key string, hash string"), str(tmp_path / name))
    at = lambda n: str(tmp_path / n)
    diff = snapshots.differences(spark, at("a"), at("b"))
    assert {(r["key"], r["why"]) for r in diff.collect()} == {("k5", "changed"), ("k77", "changed"), ("k9", "removed"), ("more", "added")}
    assert snapshots.differences(spark, at("a"), at("c")).count() == 0
    assert snapshots.differences(spark, at("none"), at("a")).count() == 3000 and snapshots.differences(spark, at("a"), at("none")).where("why = 'removed'").count() == 3000
    folders = {hashlib.sha256(k.encode()).hexdigest()[0] for k in ("k5", "k77", "k9", "more")}
    assert {f.split("folder=")[1][0] for f in diff.inputFiles() if "folder=" in f} <= set("0123456789abcdef") and len(folders) <= 4
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and all(f"{f}" in plan for f in folders)


# ---- captures

KEY = b"k"


def frame(request, sequence, data, whole, n, at, **other):
    f = {"request_id": request, "session": "s", "issued_us": 0, "expires_us": 10**9, "sequence": sequence, "final": sequence == n - 1, "bytes": len(data), "body": base64.b64encode(data).decode(), "content_hash": hashlib.sha256(whole).hexdigest(), "at_us": at}
    f |= {"mac": captures.code(f, KEY)}
    return f | other


def capture_rows():
    S = 1_000_000
    whole = b"abcdefghij"
    part = [whole[:4], whole[4:8], whole[8:]]
    ordered = lambda r, at, order=(0, 1, 2): [frame(r, i, part[i], whole, 3, a) for i, a in zip(order, at, strict=True)]
    rows = ordered("in-order", (S, 2 * S, 3 * S)) + ordered("shuffled", (S, 2 * S, 3 * S), (2, 0, 1))
    rows += ordered("late", (S, 2 * S, 200 * S)) + ordered("open", (S, 2 * S, 3 * S))[:2]
    rows += [*ordered("again", (S, 2 * S, 3 * S)), frame("again", 0, part[0], whole, 3, 4 * S)]
    rows += ordered("forged", (S, 2 * S, 3 * S))
    rows[-2] = rows[-2] | {"body": base64.b64encode(b"evil").decode()}
    rows += [frame("hash", 0, b"xxxx", b"yyyy", 1, S), frame("two-ends", 0, b"x", b"x", 1, S), frame("life", 0, b"x", b"x", 1, S)]
    rows[-1] = frame("life", 0, b"x", b"x", 1, 2 * 10**9)
    rows += [frame("size", 0, b"x", b"x", 1, S) | {"bytes": 2}]
    rows[-1] = rows[-1] | {"mac": captures.code(rows[-1], KEY)}
    return rows


WANT = {"in-order": "complete", "shuffled": "complete", "late": "expired", "open": "expired", "again": "complete", "forged": "authentication_failed", "hash": "hash_mismatch", "two-ends": "complete", "life": "session_expired", "size": "payload_too_large"}


def test_frames_become_captures(spark):
    df = spark.createDataFrame([tuple(r[n] for n in captures.NAMES) for r in capture_rows()], captures.FRAME)
    found = {r["request_id"]: r for r in captures.assembled(df, KEY).collect()}
    assert {k: r["status"] for k, r in found.items()} == WANT
    assert found["shuffled"]["n_bytes"] == 10 and found["forged"]["n_frames"] == 1 and found["open"]["decided_us"] == 121_000_000


@pytest.mark.parametrize("cuts", [1, 4])
def test_the_stream_of_frames_equals_the_batch(spark, tmp_path, cuts):
    rows = sorted(capture_rows(), key=lambda r: (r["at_us"], r["sequence"]))
    rows.append(frame("end", 0, b"x", b"x", 1, 10**10) | {"request_id": "end"})  # moves the watermark past all lives
    src = str(tmp_path / "in")
    os.makedirs(src)
    for i in range(cuts):
        some = rows[len(rows) * i // cuts : len(rows) * (i + 1) // cuts]
        spark.createDataFrame([tuple(r[n] for n in captures.NAMES) for r in some], captures.FRAME).coalesce(1).write.mode("append").parquet(src)
        files_now = sorted((os.path.join(src, f) for f in os.listdir(src) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(files_now[-1], (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(captures.FRAME).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"frames_{cuts}"
    query = captures.assembled_stream(stream, KEY).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        query.processAllAvailable()
        found = {r["request_id"]: r["status"] for r in spark.table(name).collect()}
    finally:
        query.stop()
    found.pop("end", None)
    assert found == WANT


# ---- coalescing


def event_rows(n=300, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["created", "modified", "removed", "renamed", "renamed"] + (["overflow"] if i == 50 else []))
        path = f"p{r.randint(0, 9)}"
        rows.append((f"r{r.randint(0, 3)}", i, kind, path, f"p{r.randint(0, 9)}" if kind == "renamed" else None))
    return rows


def by_hand(rows, most):
    """Event after event, as they stand."""
    out = {}
    for root in {r[0] for r in rows}:
        state, own = {}, [r for r in rows if r[0] == root]
        for _, _, kind, path, previous in sorted(own, key=lambda r: r[1]):
            if kind == "removed":
                state[path] = "removed"
            elif kind == "renamed":
                state[previous] = "removed"
                state[path] = "changed"
            elif kind != "overflow":
                state[path] = "changed"
        if len(own) <= most and not any(r[2] == "overflow" for r in own):
            out |= {(root, p): s for p, s in state.items()}
    return out


SCHEMA = "root string, seq long, kind string, path string, previous_path string"


@pytest.mark.parametrize("cuts", [1, 7])
def test_any_cut_into_micro_batches_gives_one_state(spark, tmp_path, cuts):
    rows = event_rows()
    held = coalescing.states(spark.createDataFrame(rows, SCHEMA))
    want = by_hand(rows, 80)
    assert {(r["root"], r["path"]): r["state"] for r in coalescing.coalesced(held, 80).collect()} == want and want
    mixed = list(rows)
    random.Random(1).shuffle(mixed)  # the order of arrival does not matter
    src = str(tmp_path / "in")
    for i in range(cuts):
        spark.createDataFrame(mixed[len(rows) * i // cuts : len(rows) * (i + 1) // cuts], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = coalescing.states(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    query = stream.writeStream.format("memory").queryName(f"states_{cuts}").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        query.processAllAvailable()
        assert {(r["root"], r["path"]): r["state"] for r in coalescing.coalesced(spark.table(f"states_{cuts}"), 80).collect()} == want
    finally:
        query.stop()
    batch = events.coalesce(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("root", "batch"), 80)
    assert {(r["batch"], r["path"]): r["state"] for r in batch.collect()} == want


# ---- walks


def test_a_walk_is_refused_at_each_bound(spark, tmp_path):
    for d in ("a/b/c", "d", "e"):
        (tmp_path / d).mkdir(parents=True)
        for i in range(4):
            (tmp_path / d / f"f{i}.txt").write_text("x" * i)
    os.symlink(tmp_path / "a", tmp_path / "d" / "link")
    found = {os.path.relpath(r["path"].removeprefix("file:"), tmp_path): (r["kind"], r["bytes"], r["depth"]) for r in files.walk(spark, str(tmp_path)).collect()}
    assert found["."][0] == "directory" and found["a/b/c"] == ("directory", 0, 3) and found["a/b/c/f3.txt"] == ("file", 3, 4) and len(found) == 1 + 5 + 12 + 1 + sum(k.startswith("d/link/") for k in found)
    for bound, least in (("max_entries", 5), ("max_directories", 3), ("max_depth", 3), ("max_path_bytes", 20), ("max_retained", 200), ("max_seconds", -1.0)):
        with pytest.raises(files.DiscoveryRefused, match="more than") as refused:
            files.walk(spark, str(tmp_path), **{bound: least})
        assert int(str(refused.value).rsplit("after ", 1)[1].split()[0]) <= 18
    print_of = lambda: files.namespace_fingerprint(files.walk(spark, str(tmp_path))).first()["digest"]
    first = print_of()
    assert first == print_of()
    os.utime(tmp_path / "e", (5, 5))  # a directory that was replaced
    assert print_of() != first
    assert files.walk(spark, str(tmp_path / "e")).where(F.col("kind") == "file").count() == 4
