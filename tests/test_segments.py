"""The stored index against the scan of passages, through upserts, deletes and merges; ranked retrieval against brute force."""

import collections
import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, segments
from lodestone.operators.segments import PIECE_BITS, TextIndex, blocks, postings
from lodestone.plans.query import parse_query

SCHEMA = "passage_id string, rowid long, artifact_id long, title string, media_type string, source_uri string, enabled boolean, mtime_ns long, passage_text string"
QUERIES = ("a", "b", '"a b"', '"a b" "c d" e', '"a a"', "a c", "zz", "a path:/c/1", '"b c" before:1970-01-01T00:00:00.000000040Z', "q", "q path:/c/3")


def passages(n=150, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice("aaabcde") for _ in range(r.randint(0, 30))] + (["q"] * r.randint(1, 9) if i % 2 else [])
        rows.append((f"{i // 2}:{i % 2}", i, i // 2, f"t{i % 7}", "text/plain", f"/c/{i}", i % 5 > 0, i, " ".join(words)))
    return rows


def key(df):
    return [(x["rank"], x["passage_id"], round(x["bm25"], 9), [tuple(s) for s in x["spans"]]) for x in df.orderBy("rank").collect()]


def same(spark, index, rows, queries=QUERIES, limit=7):
    p = spark.createDataFrame(rows, SCHEMA)
    for query in queries:
        assert key(index.search(query, limit)) == key(lexical.search(p, query, limit)), query
    words = collections.Counter(w for r in rows for w in r[-1].split())
    docs = collections.Counter(w for r in rows for w in set(r[-1].split()))
    assert {r["term"]: (r["doc"], r["cnt"]) for r in index.vocabulary().collect()} == {w: (docs[w], n) for w, n in words.items()}
    assert index.statistics() == (len(rows), sum(words.values()))


@pytest.mark.parametrize("block, range_tokens", [(512, 500_000), (4, 400)])
def test_index_gives_the_hits_of_the_scan(spark, tmp_path, block, range_tokens):
    rows = passages()
    index = TextIndex(spark, str(tmp_path / "i"), block, range_tokens).upsert(spark.createDataFrame(rows, SCHEMA).repartition(3))
    same(spark, index, rows)
    blocks = index.blocks().collect()
    for b in blocks:
        assert b["size"] == len(b["slots"]) == len(b["positions"]) <= block and b["most"] == max(b["counts"]) and b["least"] == min(b["lengths"])
        assert sorted(b["slots"]) == list(b["slots"]) and [len(x) for x in b["positions"]] == list(b["counts"])
    if range_tokens < 1000:
        files = index.spark.read.parquet(f"{index.path}/{index.state['segments'][0]['name']}/postings").where("term = 'a'")
        assert files.select("range").distinct().count() > 1  # a frequent term is cut


def test_changes_write_one_segment_and_marks(spark, tmp_path):
    rows = passages()
    index = TextIndex(spark, str(tmp_path / "i"), 8, 200).upsert(spark.createDataFrame(rows, SCHEMA))
    changed = [(*r[:-1], r[-1] + " a q new") for r in rows if r[2] in (3, 11, 40)] + [("900:0", 900, 900, "t0", "text/plain", "/c/900", True, 5, "a b q")]
    before = TextIndex(spark, index.path)
    index.upsert(spark.createDataFrame(changed, SCHEMA))
    now = [r for r in rows if r[2] not in (3, 11, 40)] + changed
    assert len(index.state["segments"]) == 2 and index.state["segments"][1]["passages"] == len(changed)
    same(spark, index, now, ("a", "q", '"a b"', "new"))
    same(spark, before, rows, ("a",))  # a reader of the earlier manifest sees the earlier index
    index.delete(spark.createDataFrame([(5,), (900,), (12345,)], "artifact_id long"))
    now = [r for r in now if r[2] not in (5, 900)]
    same(spark, index, now, ("a", "q", '"a b"'))
    for i in range(2):
        more = [(f"{1000 + i}:0", 1000 + i, 1000 + i, "t1", "text/plain", "/c/1", True, 7, "a q q")]
        index.upsert(spark.createDataFrame(more, SCHEMA))
        now += more
    merged = TextIndex(spark, index.path, 8, 200).merge(keep=1)
    assert len(merged.state["segments"]) == 2
    same(spark, merged, now, ("a", "q", '"a b"', "a c"))
    assert len(merged.merge(keep=0).state["segments"]) == 1 and merged.state["marks"] == []
    same(spark, merged, now, ("a", "q", '"a b"'))


@pytest.mark.parametrize("few", [10, 100_000])
def test_hits_are_broadcast_by_their_number(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(segments, "FEW", few, raising=False)
    rows = passages()
    index = TextIndex(spark, str(tmp_path / "i")).upsert(spark.createDataFrame(rows, SCHEMA).repartition(3))
    plan = index._single("q", parse_query("q"), 7)._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (few > len(rows))  # not by the compressed size of the blocks, which is small
    same(spark, index, rows, ("q", '"a b"', "a c"))


def test_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i")).upsert(spark.createDataFrame([], SCHEMA))
    assert index.search('"a b"').count() == 0 and index.search("a").count() == 0 and index.vocabulary().count() == 0
    queries = spark.createDataFrame([(1, ["a"], 1)], "query_id long, tokens array<string>, need int")
    assert index.ranked(queries, 3).count() == 0


def test_tied_scores_are_all_looked_at(spark, tmp_path):
    """Many equal passages: the order of ties decides over all blocks."""
    rows = [(f"{i}:0", i, i, f"t{(i * 37) % 101:03}", "text/plain", f"/c/{i}", True, i, "a b") for i in range(101)]
    index = TextIndex(spark, str(tmp_path / "i"), 4, 10_000).upsert(spark.createDataFrame(rows, SCHEMA))
    assert [r["title"] for r in index.search("a", 5).orderBy("rank").collect()] == [f"t{i:03}" for i in range(5)]


@pytest.mark.parametrize("by, need", [("passage_id", 1), ("artifact_id", 1), ("artifact_id", 2)])
def test_ranked_queries_agree_with_brute_force(spark, tmp_path, by, need):
    rows = passages()
    index = TextIndex(spark, str(tmp_path / "i"), 4, 150).upsert(spark.createDataFrame(rows[:100], SCHEMA).repartition(3))
    index.upsert(spark.createDataFrame(rows[100:], SCHEMA)).delete(spark.createDataFrame([(60,)], "artifact_id long"))
    rows = [r for r in rows if r[2] != 60]
    asked = [(1, ["a", "b"]), (2, ["q", "q", "e", "none"]), (3, ["none"]), (4, []), (5, list("abcdeq"))]
    df = spark.createDataFrame([(i, t, need) for i, t in asked], "query_id long, tokens array<string>, need int")
    found = sorted((r["query_id"], r["rank"], r[by], round(r["bm25"], 7)) for r in index.ranked(df, 6, by).collect())
    words = [r[-1].split() for r in rows]
    average, n = sum(map(len, words)) / len(rows), len(rows)
    want = []
    for i, tokens in asked:
        best = {}
        for r, w in zip(rows, words, strict=True):
            terms = sorted(set(tokens) & set(w))
            if not r[6] or len(terms) < need:
                continue
            score = 0.0
            for t in terms:
                df_t = sum(t in x for x in words)
                value = math.log((n - df_t + 0.5) / (df_t + 0.5))
                f = w.count(t)
                score += (value if value > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / average))
            k = r[0] if by == "passage_id" else r[2]
            best[k] = max(best.get(k, -1), round(score, 9))
        want += [(i, rank, k, round(-s, 7)) for rank, (s, k) in enumerate(sorted((-s, k) for k, s in best.items())[:6], 1) for s in [-s]]
    assert found == sorted(want)


def test_unindexed_columns_stay_with_the_hits(spark, tmp_path):
    rows = spark.createDataFrame(passages(), SCHEMA).withColumns({"passage_line": F.lit(4), "char_start": F.lit(0)})
    hit = lexical.evidence(TextIndex(spark, str(tmp_path / "i")).upsert(rows).search('"a b"', 1)).first()
    assert hit["line_start"] == 4 and hit["segments"]


def test_frequent_terms_are_exchanged_as_few_rows(spark):
    """A term's passages of a batch and chunk go as one row, and come back as they were."""
    r = random.Random(4)
    slots = sorted(r.sample(range((1 << 48) + (1 << PIECE_BITS) - 400, (1 << 48) + (1 << PIECE_BITS) + 400), 300))
    rows = [(s, [r.choice("aaaab") for _ in range(r.randint(0, 300))]) for s in slots]
    df = spark.createDataFrame(rows, "slot long, tokens array<string>").coalesce(1)
    sent = postings(df, [("a", slots[100])]).cache()
    assert sent.count() == 5  # a: 2 chunks, one of them cut by the range's end; b: 2 chunks
    back = blocks(sent.coalesce(1).sortWithinPartitions("range", "term", "slot"), 7).collect()
    found = {(b["term"], s): (length, at) for b in back for s, length, at in zip(b["slots"], b["lengths"], b["positions"], strict=True)}
    assert found == {(t, s): (len(w), [i for i, x in enumerate(w) if x == t]) for s, w in rows for t in set(w)}
    assert all(b["size"] <= 7 and {s >> PIECE_BITS for s in b["slots"]} == {b["chunk"]} and b["range"] == (b["term"] == "b" or b["slots"][0] >= slots[100]) for b in back)


def test_a_chunk_is_bounded_whatever_a_task_has_written(spark, tmp_path, monkeypatch):
    """What a task of `ranked` holds is a chunk of 2^PIECE_BITS passages, not all that one task wrote; the best are the same."""
    rows = spark.createDataFrame(passages(), SCHEMA).coalesce(1)
    queries = spark.createDataFrame([(1, ["a", "b"], 1), (2, ["q", "e"], 2)], "query_id long, tokens array<string>, need int")
    whole = TextIndex(spark, str(tmp_path / "whole")).upsert(rows)
    want = sorted(map(tuple, whole.ranked(queries, 6).collect()))
    monkeypatch.setattr(segments, "PIECE_BITS", 4)
    index = TextIndex(spark, str(tmp_path / "cut")).upsert(rows)
    assert len(whole.state["segments"][0]["chunks"]) == 1 and len(index.state["segments"][0]["chunks"]) == 10
    assert sorted(map(tuple, index.ranked(queries, 6).collect())) == want


def test_queries_are_python_objects_a_piece_at_a_time():
    """a batch of many queries in the ranking takes memory by its pieces; all of its queries come, in their order."""
    terms = [[{"term": f"w{i}-{k}", "idf": 1.0} for k in range(30)] for i in range(5000)]
    batch = pa.RecordBatch.from_pydict({"query_id": list(range(5000)), "need": [1] * 5000, "terms": terms})
    del terms

    def peak(pieces):
        tracemalloc.start()
        seen = [query for some in pieces for query, _, _ in some]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert seen == list(range(5000))
        return most

    assert peak(segments.queries_of(batch, 1500)) < peak(segments.queries_of(batch, 10**9)) / 10
    assert [q for some in segments.queries_of(batch.slice(7, 3), 1) for q in some] == [(i, 1, batch.column("terms")[i].as_py()) for i in (7, 8, 9)]
