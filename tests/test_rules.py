"""Rules that tables do not show: query language, splitter, bookmarks, rate limits, lifecycle, streams, geometry."""

import time
import itertools
import random
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import geometry, html
from lodestone.functions import text as T
from lodestone.operators import lexical, semantic
from lodestone.plans.query import InvalidQuery, parse_query, phrase_terms
from lodestone.sources import bookmarks
from lodestone.streaming import events as E

# query language


def test_parts_are_required_and_operators_are_words():
    q = parse_query('retry "isolation level" OR')
    assert q.match_expression == '"retry" AND "isolation level" AND "OR"' and q.text == "retry isolation level OR"


def test_all_filters():
    q = parse_query('"retry anomalies" path:"Research Notes" confidence:>=0.90 type:pdf after:2024-01-02 before:2024-02-01T00:00:00.5+01:00')
    f = q.filters
    assert (f.path, f.confidence, f.source_type) == ("Research Notes", (">=", 0.9), "pdf")
    assert f.after_ns == 1_704_153_600_000_000_000 and f.before_ns == 1_706_742_000_500_000_000
    assert q.phrases == ("retry anomalies",)


@pytest.mark.parametrize("bad", ["", "  ", '"open', '"a\\n"', '""', "type:pdf", "a type:", "a type:zip", "a after:tomorrow", "a confidence:2", "a path:x path:y", "a TYPE:pdf type:md", "x" * 513, "-- ??"])
def test_refused_queries(bad):
    with pytest.raises(InvalidQuery):
        parse_query(bad)


def test_quotes_escapes_and_edges():
    assert parse_query('"say \\"hi\\" \\\\ now"').phrases == ('say "hi" \\ now',)
    assert parse_query('(retry-budget), "type:pdf"').phrases == ("retry-budget", "type:pdf")
    assert phrase_terms("Retry-Budget Été") == ["retry", "budget", "ete"]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_parser_never_fails_otherwise(text):
    try:
        q = parse_query(text)
    except InvalidQuery:
        return
    assert q.phrases and all(any(c.isalnum() for c in p) for p in q.phrases)


# passages


def plain_split(text, target, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(start + target, len(text))
        if start + target < len(text):
            floor = start + target * 3 // 5
            spaces = [i for i in range(floor, end) if text[i].isspace()]
            end = spaces[-1] + 1 if spaces else end
        if text[start:end].strip():
            out.append((len(out), start, end, text[start:end]))
        if end == len(text):
            break
        start = end - min(overlap, end - start - 1)
    return out


def test_splitter(spark):
    r = random.Random(1)
    texts = ["", " \n ", "x" * 500, "a" * 80, "alpha βeta\n" * 40, *("".join(r.choice("ab cé\n ") for _ in range(r.randint(0, 900))) for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for target, overlap in ((80, 8), (100, 20)):
        got = {x["i"]: [tuple(p) for p in x["p"]] for x in rows.select("i", T.split_passages(F.col("t"), target, overlap).alias("p")).collect()}
        assert got == {i: plain_split(t, target, overlap) for i, t in enumerate(texts)}


def test_tokens(spark):
    row = spark.createDataFrame([("Ça-va_bien ÉTÉ x² straße\t42",)], "t string").select(T.tokenize_fts(F.col("t")), T.tokenize_alnum(F.col("t")), T.normalize_fusion(F.col("t")), T.char_trigrams(F.lit("AbÉd"))).first()
    assert row[0] == ["ca", "va", "bien", "ete", "x²", "straße", "42"] and row[1][0] == "ça" and row[2] == "ça va bien été x² straße 42" and row[3] == ["abÉ", "bÉd"]


# search


def test_search_counts_revoked_rows_and_marks_evidence(spark):
    texts = ["alpha beta gamma alpha", "the the the", "beta", "alpha beta", "Alpha, beta!"]
    rows = [(f"{i}:0", i, i, f"t{i}", "text/plain", f"/c/t{i}", i != 3, 10 * i, t, t, 0) for i, t in enumerate(texts)]
    p = spark.createDataFrame(rows, "passage_id string, rowid long, artifact_id long, title string, media_type string, source_uri string, enabled boolean, mtime_ns long, passage_text string, text string, char_start long")
    hits = lexical.evidence(lexical.search(p, '"alpha beta" "beta gamma"')).collect()
    assert [[(s["text"], s["highlighted"]) for s in h["segments"]] for h in hits] == [[("alpha beta gamma", True), (" alpha", False)]]
    hits = lexical.evidence(lexical.search(p, "alpha beta")).orderBy("rank").collect()
    assert {h["passage_id"] for h in hits} == {"0:0", "4:0"} and "".join(s["text"] for s in hits[0]["segments"]) in texts
    assert [s["text"] for s in next(h for h in hits if h["passage_id"] == "4:0")["segments"]] == ["Alpha", ", ", "beta", "!"]
    only = lexical.search(p.where("enabled"), "alpha").collect()[0]["bm25"]
    assert only != lexical.search(p, "alpha").collect()[0]["bm25"]
    assert lexical.search(p, "the").count() == 1 and lexical.search(p, '"the the"').collect()[0]["spans"] == [(0, 2), (1, 3)]
    assert lexical.search(p, "beta before:1970-01-01").count() == 0 and lexical.search(p, "beta path:T4").count() == 1


def test_fusion_gate_and_signals(spark):
    rows = [("a", 1, None, "retry budget text", "t", "/x", 10), ("b", None, 1, "nothing here", "t", "/x", 20), ("c", None, 2, "budget only", "retry", "/x", 20), ("d", 2, 3, "other", "t", "/x", None)]
    out = {x["passage_id"]: x for x in semantic.fuse(spark.createDataFrame(rows, "passage_id string, lexical_rank long, semantic_rank long, passage_text string, title string, source_uri string, mtime_ns long"), "Retry  budget").collect()}
    assert out.keys() == {"a", "c", "d"} and out["a"]["exact_match"] and not out["c"]["exact_match"]
    assert (out["a"]["recency"], out["c"]["recency"], out["d"]["recency"]) == (0.0, 1.0, 0.0) and out["c"]["path_overlap"] == 0.5
    assert abs(out["a"]["score"] - (0.45 / 61 + 0.10)) < 1e-12 and [x["rank"] for x in sorted(out.values(), key=lambda x: -x["score"])] == [1, 2, 3]


# HTML and bookmarks


def test_sanitizer_and_checks(spark):
    cases = {
        '<!-- x --><P class="a">One <SCRIPT>bad()</SCRIPT><b>two</b><br/></P><form>no': "<p>One two<br></p>",
        "<div><a href='x'>y</a></hr></div>": "<div><a>y</a></div>",
        "a  \n b": "a b",
        "x<!-- <p>a</p> --> y<!--z": "x y",
        "<form><script>a</script>b</form >c<form/>d<style x=1>e</style": "cd",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", html.sanitize(F.col("h")).alias("s"), html.untrusted(html.sanitize(F.col("h"))).alias("u"), html.untrusted(F.col("h")).alias("raw")).collect()
    assert {r["h"]: r["s"] for r in rows} == cases and not any(r["u"] for r in rows) and [r["raw"] for r in rows] == [True, True, False, True, True]
    bad = ["<p", "<p onclick=x>", "<video>", "</br>", "x javascript:y", "<>"]
    assert all(r[0] for r in spark.createDataFrame([(b,) for b in bad], "h string").select(html.untrusted(F.col("h"))).collect())


def test_bookmark_export():
    export = '<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><p><DT><H3 ADD_DATE="1">A &amp; B</H3><DL><p><DT><A HREF="https://x.org/?a=1&amp;b=2" ADD_DATE="5" ICON_URI="i">One <b>two</b></A><DT><A HREF="javascript:x">bad</A><DT><A>none</A></DL><p><DT><A HREF="http://y"> </A><DT><A HREF="http://z" LAST_MODIFIED="7">Z</A></DL><A HREF="http://w">open'
    out = bookmarks.parse(export)
    assert [(r[0], *r[2:]) for r in out.records] == [
        (0, "A & B", "One two", "https://x.org/?a=1&b=2", "5", None, None), (1, *[None] * 5, "invalid_url"), (2, *[None] * 5, "missing_href"), (3, *[None] * 5, "empty_title"), (4, "", "Z", "http://z", None, "7", None), (5, *[None] * 5, "unclosed_anchor"),
    ]
    assert out.application == "firefox" and out.skipped_fields == ["icon_uri"]
    with pytest.raises(bookmarks.BadExport):
        bookmarks.parse("<html></html>")


# images


def test_golden_geometry(spark):
    cases = [((0.25, 0.5, 0.5, 0.25, 800, 400, 1), (200, 100, 400, 100)), ((0.0, 0.0, 0.5, 0.5, 800, 400, 6), (0, 400, 200, 400)), ((0.1, 0.2, 0.3, 0.4, 1200, 600, 1), (120, 240, 360, 240)), ((0.1, 0.2, 0.3, 0.4, 1200, 600, 6), (60, 480, 180, 480))]
    rows = spark.createDataFrame([c[0] for c in cases], "x double, y double, w double, h double, ew int, eh int, o int")
    got = rows.select(geometry.pixel_bounds(*(F.col(c) for c in ("x", "y", "w", "h", "ew", "eh", "o"))).alias("b")).collect()
    assert [tuple(r["b"]) for r in got] == [c[1] for c in cases]
    scaled = spark.range(1).select(*(geometry.scaled_milli(F.lit(v), F.lit(2000)) for v in (3, 5, 11, 13)), geometry.confirmation(F.lit(799)), geometry.confirmation(F.lit(800))).first()
    assert tuple(scaled) == (6, 10, 22, 26, "low_confidence", "confirmed")


# events and captures


def test_rate_limit_against_plain_python(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 3), r.randint(0, 300), i) for i in range(400)]
    got = {x["seq"]: x["decision"] for x in E.rate_limit(spark.createDataFrame(rows, "key long, at_us long, seq long"), 4, 20).collect()}
    want, held = {}, {}
    for k, t, i in sorted(rows):
        q = held.setdefault(k, deque())
        while q and q[0] + 20 <= t:
            q.popleft()
        want[i] = "accept" if len(q) < 4 else "rate_limited"
        if len(q) < 4:
            q.append(t)
    assert got == want


def test_lifecycle_table(spark):
    states = ["requested", "accepted", "rejected", "expired", "revoked", "deleted"]
    to = {"requested": [], "accepted": ["accept"], "rejected": ["reject"], "expired": ["expire"], "revoked": ["accept", "revoke"], "deleted": ["accept", "delete"]}
    moves = ["accept", "reject", "expire", "revoke", "repair", "delete"]
    rows = [(f"{s} {m}", i, e) for s, m in itertools.product(states, moves) for i, e in enumerate([*to[s], m])]
    got = {x["capture"]: (x["state"], x["illegal"]) for x in E.lifecycle(spark.createDataFrame(rows, "capture string, seq int, event string")).collect()}
    assert len(got) == 36 and sum(n == 0 for _, n in got.values()) == 7 == len(E.MOVES)
    assert all(got[f"{s} {m}"] == ((E.MOVES[s, m], 0) if (s, m) in E.MOVES else (s, 1)) for s, m in itertools.product(states, moves))


def test_coalescing(spark):
    rows = [(1, 0, "created", "a", None), (1, 1, "removed", "a", None), (1, 2, "modified", "b", None), (1, 3, "renamed", "c", "b"), (1, 4, "removed", "d", None), (1, 5, "created", "d", None), (2, 0, "overflow", None, None), (2, 1, "created", "a", None)]
    e = spark.createDataFrame(rows, "batch int, seq int, kind string, path string, previous_path string")
    assert sorted(map(tuple, E.coalesce(e, 100).collect())) == [(1, "a", "removed"), (1, "b", "removed"), (1, "c", "changed"), (1, "d", "changed")]
    assert {r["batch"]: (r["full_rescan"], r["changed"], r["removed"]) for r in E.plans(e, 100).collect()} == {1: (False, 2, 2), 2: (True, 0, 0)}
    assert E.coalesce(e, 5).count() == 0


def test_streams(spark, tmp_path):
    day = 86_400_000_000  # a stream's event times start after 1970
    rows = [(1, day + t, t) for t in range(6)] + [(2, day, 9)]
    spark.createDataFrame(rows, "key long, at_us long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, at_us long, seq long").parquet(f"{tmp_path}/in")
    q = E.rate_limit_stream(stream, 4, 1000).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["seq"], r["decision"]) for r in spark.table("limited").collect()) == [(i, "accept" if i < 4 else "rate_limited") for i in range(6)] + [(9, "accept")]
    spark.createDataFrame([(0, "created", "a", None), (1, "removed", "a", None)], "seq int, kind string, path string, previous_path string").coalesce(1).write.parquet(f"{tmp_path}/ev")
    seen = []
    events = spark.readStream.schema("seq int, kind string, path string, previous_path string").parquet(f"{tmp_path}/ev")
    q = E.coalesced_stream(events, 10, lambda paths, plans, epoch: seen.extend(map(tuple, paths.select("path", "state").collect()))).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert seen == [("a", "removed")]


def test_tag_reader_is_linear_and_keeps_offsets():
    from lodestone.functions import markup

    page = "İ" * 40 + '<a HREF="x>y" b=\'>\'>t</A><!-- <p> --><br/>1 < 2<p'
    got = [(t.name, t.closing, t.closed, page[t.start : t.stop]) for t in markup.tags(page)]
    assert got == [("a", False, False, '<a HREF="x>y" b=\'>\'>'), ("a", True, False, "</A>"), ("", False, False, "<!-- <p> -->"), ("br", False, True, "<br/>")]
    assert markup.end_tag("İ</SCRIPT >", "script", 0) == (1, 11) and markup.end_tag("</scripts>", "script", 0) == (-1, -1)
    began = time.monotonic()
    for part in ("<a '", '<a "\'', "<a ", "<!", "<!--x", '<a x="', "<a x=\"'", "<a><!x", "</x"):
        n = len(list(markup.tags(part * 200_000 + "\"'>\"")))
        assert n <= 200_001
    assert time.monotonic() - began < 30


def test_bookmarks_after_letters_that_grow_in_lower_case():
    rows = "".join(f'<DT><A HREF="http://x/{i}">{"İ" * 40 if i == 0 else "T"}{i}</A>' for i in range(3))
    out = bookmarks.parse(f"<!DOCTYPE NETSCAPE-Bookmark-file-1><DL>{rows}</DL>")
    assert [(r[3], r[4]) for r in out.records] == [("İ" * 40 + "0", "http://x/0"), ("T1", "http://x/1"), ("T2", "http://x/2")]


def test_vector_search_against_brute_force(spark):
    from lodestone.operators import semantic as S

    r = random.Random(12)
    rows = [(i, [r.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(4)]) for i in range(120)] + [(200, None), (None, [1.0, 1.0, 0.0, 0.0]), (None, [1.0, 2.0, 0.0, 0.0]), (201, [1.0]), (202, [0.0] * 4), (5, rows5 := [2.0, 2.0, 2.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in rows if i is not None and i % 10 == 0] + [(5, rows5)], "query_id long, q array<double>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return None
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else None

    for block in (4096, 5):
        out = S.vector_topk(vectors, queries, 7, block).collect()
        for i, q in [(i, v) for i, v in rows if i is not None and i % 10 == 0 and v and any(v)]:
            scored = sorted(((-round(c, 9), v is not None, v or 0) for v, e in rows if (c := cosine(q, e)) is not None))[:7]
            got = [(-round(x["similarity"], 9), x["vec_id"] is not None, x["vec_id"] or 0) for x in sorted((x for x in out if x["query_id"] == i), key=lambda x: x["rank"])]
            assert [g[0] for g in got] == [w[0] for w in scored], i
    assert S.vector_topk(vectors, queries.where("false")).count() == 0 and S.vector_topk(vectors.where("false"), queries).count() == 0
