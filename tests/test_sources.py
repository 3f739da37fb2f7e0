"""Sources and sinks: files, query files, pages and regions, portable export, captures, job queue."""

import base64
import hashlib
import json
import os
import random

import pytest

from lodestone.operators import jobs
from lodestone.sources import capture, files, portable


def test_discovery_and_texts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in {"b.md": b"# x\r\ny\rz", "a/c.TXT": "é".encode(), "a/bad.txt": b"\xff\xfe", "a/control.txt": b"a\x01b", "skip.zip": b"z"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.discover(spark, str(tmp_path)).orderBy("position").collect()
    assert [os.path.basename(r["path"]) for r in found] == ["bad.txt", "c.TXT", "control.txt", "b.md"] and found[3]["media_type"] == "text/markdown"
    assert len(files.fingerprint(files.discover(spark, str(tmp_path))).first()["digest"]) == 64
    with pytest.raises(files.DiscoveryRefused):
        files.discover(spark, str(tmp_path), max_files=3)
    got = {os.path.basename(r["path"]): (r["text"], r["problem"]) for r in files.extract_texts(spark, str(tmp_path)).collect()}
    assert got == {"b.md": ("# x\ny\nz", None), "c.TXT": ("é", None), "bad.txt": (None, "not_utf8"), "control.txt": (None, "control_characters")}


def test_query_file(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text(json.dumps({"id": "q1", "query": '"a b"', "source_type": "local_text", "expected_file": "f", "expected_anchor": {"kind": "text", "char_start": 60, "char_end": 75}, "negative": False}) + "\n")
    row = files.read_queries(spark, str(path)).first()
    assert row["expected_anchor"]["char_end"] == 75 and row["reformulations"] is None


def test_pages_and_regions(spark):
    p = spark.createDataFrame([(1, 2, "second page text\n"), (1, 1, "\nfirst page text"), (1, 3, " ")], "doc_id long, page int, text string")
    assert [(r["ordinal"], r["page"], r["char_start"], r["char_end"]) for r in files.page_passages(p).orderBy("ordinal").collect()] == [(0, 1, 0, 15), (1, 2, 0, 16)]
    r = spark.createDataFrame([("i", 0, "ab"), ("i", 1, "c"), ("j", 0, "d")], "image_id string, idx int, text string")
    assert sorted(map(tuple, files.region_passages(r).collect())) == [("i", 0, 0, 2, 1, "ab"), ("i", 1, 3, 4, 2, "c"), ("j", 0, 0, 1, 1, "d")]


LAYOUT = {"roots": portable.Table("id long, name string", "id"), "items": portable.Table("id long, root long, body string", "id", (("root", "roots"),))}


def test_portable_round_trip_and_refusals(spark, tmp_path):
    roots = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    items = spark.createDataFrame([(i, 1 + i % 2, f"é{i}") for i in range(2500)], "id long, root long, body string")
    path = str(tmp_path / "x")
    portable.export({"roots": roots, "items": items}, LAYOUT, path)
    back = portable.read(spark, LAYOUT, path)
    assert sorted(map(tuple, back["items"].collect())) == sorted(map(tuple, items.collect())) and sorted(map(str, back["roots"].collect())) == sorted(map(str, roots.collect()))
    portable.export({"roots": roots.where("id = 1"), "items": items}, LAYOUT, str(tmp_path / "y"))
    with pytest.raises(portable.ImportRefused, match="without their roots"):
        portable.read(spark, LAYOUT, str(tmp_path / "y"))
    part = next(f for f in os.listdir(f"{path}/items") if f.endswith(".json"))
    lines = open(f"{path}/items/{part}").read()
    os.remove(f"{path}/items/.{part}.crc")
    open(f"{path}/items/{part}", "w").write(lines.replace('"é1"', '"changed"').replace('"é0"', '"changed"'))
    with pytest.raises(portable.ImportRefused):
        portable.read(spark, LAYOUT, path)
    with pytest.raises(portable.ImportRefused):
        portable.read(spark, LAYOUT, str(tmp_path / "none"))


def test_captures(spark):
    key, body = b"k" * 32, '{"b": 1, "a": [2, {"d": 1, "c": "é"}]}'
    rows = spark.createDataFrame([(1, body, capture.code('{"a":[2,{"c":"é","d":1}],"b":1}', key)), (2, body, "0" * 64), (3, "{", "x"), (4, None, None)], "id long, body string, mac string")
    assert {r["id"]: r["authentic"] for r in capture.authenticated(rows, key).collect()} == {1: True, 2: False, 3: False, 4: False}
    checked = rows.where("id < 4").select("id", capture.field_problem(rows["body"], ["a", "b"], ["a"]).alias("x"), capture.field_problem(rows["body"], ["a"], []).alias("y"), capture.field_problem(rows["body"], ["a", "b"], ["z"]).alias("z")).collect()
    assert [tuple(r)[1:] for r in checked] == [(None, "unknown_field", "missing_field")] * 2 + [("not_an_object",) * 3]
    data = random.Random(1).randbytes(1000)
    sha, enc = hashlib.sha256(data).hexdigest(), lambda a, b: base64.b64encode(data[a:b]).decode()
    chunks = [("ok", 1, 2, enc(400, 1000), sha), ("ok", 0, 2, enc(0, 400), sha), ("half", 0, 2, enc(0, 400), sha), ("bad", 0, 1, enc(0, 999), sha), ("large", 0, 1, "A" * 300_000, sha)]
    got = {r["capture_id"]: (r["problem"], r["payload"]) for r in capture.reassembled(spark.createDataFrame(chunks, "capture_id string, index int, total int, data string, sha256 string")).collect()}
    assert got == {"ok": (None, bytearray(data)), "half": ("incomplete", None), "bad": ("hash_mismatch", None), "large": ("too_large", None)}


def test_job_queue(spark):
    rows = [(1, 0, "a", "index", 1), (1, 1, "a", "index", 1), (1, 2, "a", "index", 2), (1, 3, "b", "index", 0), (1, 4, "c", "index", 0), (1, 5, "c", "index", 0)]
    r = spark.createDataFrame(rows, "queue long, seq long, key string, operation string, priority int")
    assert [x["outcome"] for x in jobs.admitted(r, 2).orderBy("seq").collect()] == ["admitted", "repeated", "conflict", "admitted", "refused", "refused"]
    j = spark.createDataFrame([(1, s, p) for s, p in enumerate([0, 1, 2, 2, 2, 2, 2, 2])], "queue long, sequence long, priority int")
    assert [x["sequence"] for x in jobs.claim_sequence(j).orderBy("claim").collect()] == [2, 3, 4, 5, 0, 6, 7, 1]
    s = spark.createDataFrame([("running", 1, 3, False, True), ("running", 3, 3, False, True), ("running", 1, 3, True, True), ("running", 1, 3, False, False), ("queued", 0, 3, False, False)], "state string, attempts int, max_attempts int, cancel_requested boolean, failed boolean")
    assert [x["next_state"] for x in jobs.next_states(s).collect()] == ["retryable", "failed", "cancelled", "completed", "queued"]
