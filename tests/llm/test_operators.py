"""Each operator against a brute-force version, and on nulls, empty tables, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, html_extract, kneser_ney, license_scan, near_dedup, quality_rules, sharding, source_mix, substring_dedup, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=120, seed=3):
    """Words, copies, near copies, shared passages, repeats, a null, an empty and a very long text."""
    r = random.Random(seed)
    vocab = [f"w{r.randint(0, 10**6)}" for _ in range(400)] + ["the", "of", "and"] * 20
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = sentence(60)
    rows = []
    for i in range(n):
        kind = i % 10
        text = sentence(r.randint(25, 90)) + "\n" + sentence(30)
        if kind == 1 and rows:
            text = rows[r.randrange(len(rows))][1]
        elif kind == 2 and rows:
            words = (rows[r.randrange(len(rows))][1] or "a b").split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = f"{text}\n{passage}\n{sentence(10)}"
        elif kind == 4:
            text = "\n".join([sentence(9)] * r.randint(2, 9))
        elif kind == 5:
            text = sentence(r.randint(0, 6))
        rows.append((i, text, ("en", "de")[i % 2], f"src{i % 4}" if i % 11 else None, len(text)))
    rows.append((n, None, None, "src0", None))
    rows.append((n + 1, "", "en", "src1", 0))
    rows.append((n + 2, sentence(30_000), "en", "src2", 0))
    rows.append(rows[5])
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# sharding


def test_shards_are_even_gapless_and_keep_groups(docs):
    rows = documents()
    out = sharding.shard_rows(docs, 4).collect()
    assert sorted((r["doc_id"], r["__ls_size"]) for r in out) == sorted((r[0], len((r[1] or "").encode()) + 1) for r in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["__ls_shard"]].append(r)
    for held in by.values():
        assert sorted(r["__ls_slot"] for r in held) == list(range(len(held)))
    total, most = sum(r["__ls_size"] for r in out), max(r["__ls_size"] for r in out)
    assert all(sum(r["__ls_size"] for r in held) <= total / 4 + most for held in by.values())


def test_shards_against_a_sort_of_the_whole_table(spark, docs):
    """Sorted by text hash and id, the rows must run through the shards and slots without a step back, and each
    boundary must lie within a row or the tolerance of its goal."""
    numbered = docs.withColumns({"h": F.xxhash64("text"), "clash": F.lit(1)})
    for n_shards, tolerance in ((3, 0.0), (8, 0.01)):
        out = sharding.shard_rows(numbered, n_shards, tolerance=tolerance, piece_rows=10).collect()
        ordered = sorted(out, key=lambda r: (r["h"], r["doc_id"], r["__ls_shard"], r["__ls_slot"]))
        places = [(r["__ls_shard"], r["__ls_slot"]) for r in ordered]
        assert places == sorted(set(places))
        total, below, ends = sum(r["__ls_size"] for r in out), 0, {}
        for r in ordered:
            below += r["__ls_size"]
            ends[r["__ls_shard"]] = below
        sums = [0, *itertools.accumulate(r["__ls_size"] for r in ordered)]
        for i in range(1, n_shards):
            cut, goal = max((e for s, e in ends.items() if s < i), default=0), total * i / n_shards
            assert abs(cut - goal) <= min(abs(x - goal) for x in sums) + tolerance * total / n_shards


def test_shards_cut_a_hot_group(spark):
    rows = spark.createDataFrame([(i % 50, "same text") for i in range(4000)] + [(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    out = sharding.shard_rows(rows, 8).groupBy("__ls_shard").agg(F.sum("__ls_size").alias("s"), F.count("*").alias("n"), F.max("__ls_slot").alias("m")).collect()
    assert len(out) == 8 and max(r["s"] for r in out) - min(r["s"] for r in out) < 300
    assert all(r["m"] == r["n"] - 1 for r in out)


def test_shards_of_nothing_and_clashing_names(spark, empty):
    assert sharding.shard_rows(empty, 8).count() == 0
    rows = spark.createDataFrame([(1, "a", 5, 6, 7), (None, None, 5, 6, 7)], "doc_id long, text string, shard int, slot int, size int")
    assert sharding.shard_rows(rows, 2).select("shard", "slot", "size").distinct().collect() == [(5, 6, 7)]


def test_op1_columns(spark, sf_dir):
    out = sharding.op1_histogram_sort(spark, sf_dir)
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in out.collect():
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None


# quality rules


def brute_repeats(ws, least):
    covered, longest = set(), 0
    for k in range(1, len(ws)):
        seen = collections.defaultdict(list)
        for i in range(len(ws) - k + 1):
            seen[tuple(ws[i : i + k])].append(i)
        again = [i for v in seen.values() if len(v) > 1 for i in v]
        if not again:
            break
        longest = k
        if k >= least:
            covered.update(i + j for i in again for j in range(k))
    return len(covered), longest


def test_repetition_against_brute_force():
    texts = [r[1] for r in documents(40) if r[1] is None or len(r[1]) < 5000]
    got = quality_rules.measure([t.encode() if t is not None else None for t in texts])
    for i, text in enumerate(texts):
        ws = words(text)
        assert got["n_words"][i] == len(ws)
        assert (got["n_covered_words"][i], got["longest_repeat"][i]) == brute_repeats(ws, quality_rules.MIN_REPEAT)
        assert got["n_repeat_words"][i] == brute_repeats(ws, 8)[0]
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))


def test_quality_filter_keeps_columns_and_clean_documents(spark, empty):
    clean = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(1, clean, 9), (2, " ".join(["a b c d e f"] * 20), 9), (3, None, 9), (4, "", 9), (1, clean, 9)], "doc_id long, text string, kept int")
    assert quality_rules.filter_documents(rows).collect() == [(1, clean, 9)] * 2
    assert quality_rules.filter_documents(empty).count() == 0 and quality_rules.score_documents(empty).count() == 0


# near duplicates


def brute_components(rows, k, threshold=0.8):
    sets, root = [], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        ws = [w.encode().lower() for w in words(r[1])]
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set())
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 100 * threshold * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = collections.defaultdict(lambda: math.inf)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    return {r[0]: (len(sets[i]), least[find(i)]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(docs, k):
    want = brute_components(documents(), k)
    out = near_dedup.near_duplicates(docs, shingle=k).collect()
    assert len(out) == len(documents())
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_a_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(200):
        base = [*base[:]]
        base[(7 * i) % 60] = f"n{i}"
        rows.append((i, " ".join(base)))
    near_dedup_block = near_dedup.BLOCK_IDS
    near_dedup.BLOCK_IDS = 16
    try:
        out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    finally:
        near_dedup.BLOCK_IDS = near_dedup_block
    want = brute_components(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: c for i, (_, c) in want.items()}


def boilerplate(n, shared=160, own=50):
    common_ = [f"c{i}" for i in range(shared)]
    return [(i, " ".join([*common_, *(f"o{i}x{j}" for j in range(own))])) for i in range(n)]


def test_documents_with_common_boilerplate_ask_few_blocks(spark, monkeypatch):
    """What the complete search compares grows with the documents, and no block holds more than its bound."""
    asked, kept = {}, near_dedup.common.staged

    def seen(df, name):
        out = kept(df, name)
        if name == "asks":
            asked[len(asked)] = out.count()
        return out

    monkeypatch.setattr(near_dedup.common, "staged", seen)
    for n in (300, 900):
        rows = [*boilerplate(n), (9000, boilerplate(1)[0][1] + " more")]
        out = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
        assert out == {i: i if i < 9000 else 0 for i, _ in rows}
    assert all(n <= 100 for n in asked.values())


def test_first_shingles_meet_where_sets_are_alike():
    r = random.Random(4)
    np = near_dedup.np
    counts = np.array([r.randint(0, 50) for _ in range(64)])
    met = 0
    for _ in range(3000):
        a = {r.randrange(200) for _ in range(r.randint(1, 60))}
        b = {x for x in a if r.random() < 0.9} | {r.randrange(200) for _ in range(r.randint(0, 5))}
        if len(a) < len(b):
            a, b = b, a
        if b and 5 * len(a & b) >= 4 * len(a | b):
            of = lambda x: near_dedup.prefixes(np.array(sorted(x), np.uint64), counts, 0.8)
            (large, _), (small, m) = of(a), of(b)
            assert set(large.tolist()) & set(small[:m].tolist())
            met += 1
    assert met > 300


def test_near_duplicates_with_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (7, text + " x"), (None, "alone here"), (3, None), (None, text)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    assert got == {(None, 59, 7, False): 2, (7, 60, 7, True): 1, (None, 1, None, True): 1, (3, 0, 3, True): 1}


def test_keep_one_keeps_columns(spark, empty):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(3, text, 1), (1, text, 2), (2, None, 3), (4, "", 4), (5, "other words in this one here", 5)], "doc_id long, text string, root int")
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(rows).collect()) == [1, 2, 4, 5]
    assert near_dedup.keep_one(rows).columns == rows.columns
    assert near_dedup.keep_one(empty).count() == 0 and near_dedup.near_duplicates(empty).count() == 0


def test_keep_one_leaves_one_row_of_repeated_and_null_ids(spark):
    text = lambda a, *changed: " ".join(changed[0] if changed and i == 9 else f"{a}{i}" for i in range(90))
    rows = [(1, text("a"), 1)] * 3 + [(1, text("a", "near"), 1), (2, text("a"), 2)]  # repeated rows and near copies of one id
    rows += [(None, text("b"), 3), (None, text("b", "near"), 3), (None, text("b"), 3), (None, text("c"), 4), (None, text("c"), 4)]
    rows += [(1, text("d"), 5), (None, text("e"), 6), (7, text("e"), 6), (8, "", 7), (8, "", 7), (None, None, 8)]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, grp int").repartition(parts)
        got = collections.Counter((r["grp"], r["doc_id"]) for r in near_dedup.keep_one(docs).collect())
        assert got == {(1, 1): 1, (3, None): 1, (4, None): 1, (5, 1): 1, (6, 7): 1, (7, 8): 2, (8, None): 1}


# substring dedup


def brute_substrings(rows, length):
    seen = collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[r[0]] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "hot"), [(200, 20_000), (200, 2), (40, 20_000), (40, 2)])
def test_substrings_against_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SORT_BYTES", 4000)
    rows = [r for r in documents(60) if r[1] is None or len(r[1]) < 20_000] + [(900, "ab" * 700, "en", "s", 0), (901, "é" * 150 + "x", "en", "s", 0), (902, "q" * 199, "en", "s", 0), (903, "\0" * 450 + "z", "en", "s", 0), (904, "y" + "\0" * 300, "en", "s", 0)]
    want = brute_substrings(rows, length)
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], f"{DOCS}, n_removed int, context binary")
    out = substring_dedup.deduplicate(docs, length=length, gram=min(32, length // 2)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_anchors_are_the_leftmost_least_grams():
    r = random.Random(9)
    for length, gram in ((200, 32), (40, 20), (12, 4)):
        for alphabet in (b"ab", bytes(range(256)), b"a"):
            data = bytes(r.choice(alphabet) for _ in range(900))
            x = substring_dedup.np.frombuffer(data, "u1")
            names, first, place, n = substring_dedup.entries(x, length, gram)
            at = [i for f, m in zip(first, n, strict=True) for i in range(f, f + m)]
            assert at == list(range(len(data) - length + 1))
            seen = {}
            for name, f, p, m in zip(names.tolist(), first.tolist(), place.tolist(), n.tolist(), strict=True):
                for i in range(f, f + m):
                    offset = f + p - i
                    assert 0 <= offset <= length - gram and seen.setdefault(data[i : i + length], (name, offset)) == (name, offset)
                    own = data[f + p : f + p + gram]
                    assert own not in [data[i + j : i + j + gram] for j in range(offset)]


def test_multikey_quicksort_is_a_sort():
    r = random.Random(2)
    rows = [bytes(r.choice(b"\0ab") for _ in range(21)) for _ in range(300)] + [b"\0" * 21] * 5 + [b"a" * 21] * 9
    order, prefix = substring_dedup.multikey_quicksort(substring_dedup.np.frombuffer(b"".join(rows), "u1").reshape(-1, 21))
    got = [rows[i] for i in order]
    assert got == sorted(rows) and sorted(order.tolist()) == list(range(len(rows)))
    for (a, b), n in zip(itertools.pairwise(got), prefix[1:].tolist(), strict=True):
        assert a[:n] == b[:n] and (n == 21 or a[n] != b[n])


def test_a_passage_in_very_many_texts(spark, monkeypatch):
    """Near copies with one hot passage: ties beyond a token's bound are found in all ways alike."""
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [(i, f"{hashlib.sha256(str(i).encode()).hexdigest()} {passage} {i} {hashlib.md5(str(i).encode()).hexdigest()}" * (1 + i % 2)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = []
    for hot in (20_000, 500):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got.append(sorted(substring_dedup.deduplicate(docs).drop("spans").collect()))
    assert got[0] == got[1]
    want = brute_substrings(rows, 200)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got[0])


def test_substrings_of_nothing_and_of_long_texts(spark, empty):
    assert substring_dedup.deduplicate(empty).count() == 0
    r = random.Random(8)
    words_ = [f"w{r.randint(0, 10**6)}" for _ in range(5000)]
    text = " ".join(r.choice(words_) for _ in range(200_000))
    rows = [(1, text + " " + text[1000:1500]), (2, None), (3, text[70_000:70_300])]
    out = {r["doc_id"]: r for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[3]["n_removed"] == 300 and out[2]["n_bytes"] == 0 and out[1]["n_spans"] == 3 and 1300 <= out[1]["n_removed"] <= 1310


# decontamination


def test_decontamination_finds_copies_with_substitutions(spark, empty):
    r = random.Random(5)
    fresh = lambda n: [f"v{r.randint(0, 10**9)}" for _ in range(n)]
    items = [fresh(40) for _ in range(20)] + [fresh(4), ["the"], []]
    docs, want = [], set()
    for i in range(60):
        body = fresh(r.randint(0, 300))
        if i % 3 == 0:
            item = r.randrange(20)
            copy = [w.upper() + "," for w in items[item]]
            for j in range(i % 4, 40, 9):
                copy[j] = "other"
            body[len(body) // 2 : len(body) // 2] = copy
            want.add((i, item))
        elif i % 3 == 1 and i < 10:
            body += items[20]
            want.add((i, 20))
        docs.append((i, " ".join(body), i))
    docs += [(100, None, 1), (101, "", 1), (102, "the", 1)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 500):
        got = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(rows, bench, block_bytes=block).collect()}
        assert got == want
        kept = decontamination.remove_contaminated(rows, bench, block_bytes=block)
        assert {x["doc_id"] for x in kept.collect()} == {d[0] for d in docs} - {d for d, _ in want} and kept.columns == rows.columns
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(rows, bench.where("false")).count() == 0


def test_whole_copies_of_short_items_with_substitutions_at_every_place():
    for n in range(5, 21):
        item = [f"i{n}x{j}" for j in range(n)]
        seeds = decontamination.Seeds([(7, " ".join(item))])
        for changed in (1, 2, 3):
            for at in itertools.combinations(range(n), changed):
                copy = [f"other{j}" if j in at else w for j, w in enumerate(item)]
                flat, _ = decontamination.word_hashes([" ".join(["a", "b", *copy, "c"])])
                found = seeds.overlaps(flat)
                enough = n - changed >= max(decontamination.MIN_WORDS, decontamination.MIN_IDENTITY * n)
                assert bool(found) == enough or (found and found[0][1] >= decontamination.MIN_MATCHED), (n, at)


def brute_overlaps(items, text):
    """Items that the rules find, by every diagonal that a seed or an intact run gives."""
    ws, out = text.split(), set()
    for i, item in enumerate(items):
        n = len(item)
        least = max(decontamination.MIN_WORDS, math.ceil(decontamination.MIN_IDENTITY * n))
        for d in range(-n + 1, len(ws)):
            same = [0 <= j + d < len(ws) and ws[j + d] == w for j, w in enumerate(item)]
            seeded = any(all(j + k < n and same[j + k] for k, x in enumerate(mask) if x == "1") and j + len(mask) <= n and 0 <= j + d and j + d + len(mask) <= len(ws) for mask in decontamination.MASKS for j in range(n))
            if not seeded and sum(same) < least:
                continue
            most = max((sum(same[a:b]) for a in range(max(0, -d), n) for b in range(a + 1, min(n, len(ws) - d) + 1) if sum(same[a:b]) >= decontamination.MIN_IDENTITY * (b - a)), default=0)
            if seeded and most >= min(decontamination.MIN_MATCHED, n):
                out.add(i)
            if n >= decontamination.MIN_WORDS and sum(same) >= least:
                out.add(i)
    return out


def test_overlaps_against_brute_force():
    r = random.Random(21)
    vocab = [f"k{i}" for i in range(30)]
    items = [["open", "with", "these", "same", "words"] + [r.choice(vocab) for _ in range(r.randint(0, 30))] for _ in range(25)]
    seeds = decontamination.Seeds([(i, " ".join(x)) for i, x in enumerate(items)])
    found = 0
    for _ in range(60):
        body = [r.choice(vocab) for _ in range(30)]
        own = list(r.choice(items))
        for j in r.sample(range(len(own)), min(len(own), r.randint(0, 5))):
            own[j] = "other"
        text = " ".join(body[:15] + own[: r.randint(3, len(own))] + body[15:])
        got = {x[0] for x in seeds.overlaps(decontamination.word_hashes([text])[0])}
        assert got == brute_overlaps(items, text)
        found += len(got)
    assert found > 40


def test_parts_of_items_with_substitutions_are_found():
    """Parts of 60-word items that meet the rule: the masks may miss some, the recall is at least 0.9 everywhere."""
    r = random.Random(4)
    item = [f"i{j}" for j in range(60)]
    seeds = decontamination.Seeds([(7, " ".join(item))])
    for n, changed in ((14, 1), (14, 2), (16, 3), (18, 3), (20, 4), (24, 6), (30, 7)):
        found = 0
        for _ in range(200):
            first = r.randint(0, 60 - n)
            part = item[first : first + n]
            for at in r.sample(range(n), changed):
                part[at] = "other"
            text = " ".join([*(f"b{j}" for j in range(20)), *part, *(f"c{j}" for j in range(20))])
            found += bool(seeds.overlaps(decontamination.word_hashes([text])[0]))
        assert found >= 180, (n, changed, found)


def test_items_with_one_opening_do_not_slow_a_text_down():
    items = [(i, f"read the next passage and answer it then {i} " + " ".join(f"q{i}x{j}" for j in range(20))) for i in range(2000)]
    text = " ".join(f"read the next passage and answer it then none{i}" for i in range(40))
    seeds = decontamination.Seeds(items)
    began = time.monotonic()
    assert seeds.overlaps(decontamination.word_hashes([text])[0]) == []
    assert time.monotonic() - began < 2


# page extraction


def test_crf_on_held_out_pages():
    from lodestone.llm.html_blocks import leaf_blocks
    from lodestone.llm.page_grammar import LABEL, labelled_pages

    crf, wrong, n = html_extract.model(), 0, 0
    for page in labelled_pages(300, seed=77):
        blocks = leaf_blocks(page)
        gold = [b.text.startswith(LABEL) for b in blocks]
        for b in blocks:
            b.text = b.text.removeprefix(LABEL) or "."
        wrong += sum(a != b for a, b in zip(gold, crf.decode(blocks), strict=True))
        n += len(gold)
    assert n > 2000 and wrong / n < 0.01


def test_viterbi_finds_the_best_path():
    from lodestone.llm.html_blocks import leaf_blocks

    crf = html_extract.model()
    blocks = leaf_blocks("<nav><a href='x'>Menu</a></nav><p>One two three.</p><div>Four</div><article><p>Five six.</p></article><footer>&copy; x</footer>")
    scores = [[sum(crf.weights.get(f, (0, 0))[s] for f in fs) for s in (0, 1)] for fs in html_extract.features(blocks)]
    best = max(itertools.product((0, 1), repeat=len(blocks)), key=lambda p: crf.starts[p[0]] + sum(scores[i][s] for i, s in enumerate(p)) + sum(crf.moves[a][b] for a, b in itertools.pairwise(p)))
    assert crf.decode(blocks) == [bool(s) for s in best]


def test_extraction_of_odd_pages(spark):
    page = "<html><head><title>no</title><script>var x='<p>no</p>'</script></head><body><nav><a href=/>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n  two<b> bold</b>&nbsp;three<p>Four &lt;five&gt;</article><div class=comments><p>Nice text, I like it.</p></div><footer>&copy; me</footer>"
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<<<>>><p", 1), (1, "u", page, 1)], "page_id long, url string, html string, text long")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(rows).collect())
    text = "A & B\nOne two bold three\nFour <five>"
    assert got[:2] == [(1, text, len(text))] * 2 and got[2:4] == [(2, "", 0), (3, "", 0)]
    assert html_extract.extract(rows.where("false")).count() == 0


#: Hand-written pages in shapes that the training grammar has not; blocks that begin with + are main text.
PAGES = (
    """<body><table><tr><td width=150><a href=/>Home</a><br><a href=/a>About us</a></td><td><h1>+A day at the sea</h1><p>+We left the town at six in the morning, when the streets were still empty.<p>+The road follows the river for an hour and then climbs into the hills.<p>+At noon we saw the water, and nobody spoke for a while.</td></tr></table><p align=center><small>Copyright 1999 Ann. <a href=/m>Write me</a></small>""",
    """<div class="l-wrap"><div class="topbar"><a href=/>News</a> <a href=/s>Sport</a> <a href=/w>Weather</a></div><div class="l-col"><h1 class="headline">+Council votes for new bridge</h1><div class="byline">+By a reporter</div><div class="body"><p>+The council voted on Tuesday for a new bridge over the river, after a debate of four hours.</p><p>+Work will begin in spring, the mayor said, and take two years.</p><h3>+What it costs</h3><p>+The plan puts the price at nine million, a third of it from the state.</p></div></div><div class="sidebar-right"><h4>Most read</h4><ul><li><a href=/1>Storm hits coast</a></li><li><a href=/2>Team wins cup</a></li></ul></div><footer><p>&copy; The paper. All rights reserved.</p></footer></div>""",
    """<header id="top"><img alt=logo><nav><a href=/>Start</a><a href=/docs>Docs</a></nav></header><main class="docs"><h1>+Install</h1><p>+Download the archive and unpack it anywhere you like.</p><pre>+tar xf tool.tar.gz</pre><h2>+First steps</h2><ol><li>+Open a terminal in the folder.</li><li>+Run the program once, so that it writes its settings.</li></ol><blockquote><p>+Settings are kept in your home folder.</p></blockquote></main><div class="pagination"><a href=/p>Previous</a> <a href=/n>Next</a></div><footer>&copy; the project</footer>""",
    """<div id="page"><div id="cookie-notice"><p>This site uses cookies. <a href=/c>More</a> <button>OK</button></p></div><section class="post"><h2>+On bread</h2><p>+Good bread needs four things, and the fourth is time. +I bake on Sundays.</p><div class="advertisement"><p>Buy a better oven today!</p></div><p>+Mix the flour and the water first and leave them alone for an hour.</p><p>+Then add salt and the leaven, and fold the dough every half hour until evening.</p></section><section id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely, I will try this.</p></div><div class="comment"><p>Mine came out flat, what did I do wrong?</p></div></section></div>""",
)


def test_crf_on_hand_labelled_pages_of_other_shapes():
    from lodestone.llm.html_blocks import leaf_blocks

    crf, right, n = html_extract.model(), 0, 0
    for page in PAGES:
        blocks = leaf_blocks(page)
        gold = [b.text.startswith("+") for b in blocks]
        for b in blocks:
            b.text = b.text.removeprefix("+")
        right += sum(a == b for a, b in zip(gold, crf.decode(blocks), strict=True))
        n += len(gold)
    assert n == 38 and right / n >= 0.85, (right, n)


def test_training_climbs_the_likelihood():
    """The gradient that training follows is that of the likelihood, summed over all paths by brute force."""
    from lodestone.llm.html_blocks import leaf_blocks
    from lodestone.llm.page_grammar import LABEL

    pages = [f"<nav>Menu</nav><article><p>{LABEL}One two.</p></article>", f"<p>{LABEL}Three.</p><footer>Four</footer>", f"<article><p>{LABEL}Five six seven.</p><p>{LABEL}Eight.</p></article>"]

    def loss(crf):
        total = 0.0
        for page in pages:
            blocks = leaf_blocks(page)
            gold = tuple(int(b.text.startswith(LABEL)) for b in blocks)
            for b in blocks:
                b.text = b.text.removeprefix(LABEL)
            found = html_extract.features(blocks)
            score = lambda y: crf.starts[y[0]] + sum(crf.weights.get(f, (0, 0))[s] for fs, s in zip(found, y, strict=True) for f in fs) + sum(crf.moves[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
            total += math.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=len(blocks)))) - score(gold)
        return total

    flat = html_extract.train(pages, passes=0)
    stepped = html_extract.train(pages, passes=1, rate=1e-4, penalty=0.0)
    # AdaGrad's first step is rate * sign(gradient): every weight that moved must lower the loss by itself
    for name, (w0, w1) in stepped.weights.items():
        for s, w in enumerate((w0, w1)):
            if abs(w) > 1e-5:
                one = html_extract.Model(flat.weights | {name: (w, 0.0) if s == 0 else (0.0, w)}, flat.moves, flat.starts)
                assert loss(one) < loss(flat), name
    assert loss(html_extract.train(pages, passes=60)) < 0.2 * loss(flat)


def test_extraction_keeps_what_follows_letters_that_grow_in_lower_case(spark):
    page = "<article><p>" + "İ" * 40 + " one.</p><SCRIPT>var x</Script><p>Two three.</p></article>"
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_extract.extract(rows).first()["text"] == "İ" * 40 + " one.\nTwo three."


def test_pages_that_are_long_unclosed_or_deep_take_linear_time():
    crf = html_extract.model()
    began = time.monotonic()
    for page in ("<a '" * 250_000, "<div>x" * 100_000, "".join(f"<div class=c{i % 5000}>" for i in range(50_000)) + "x", "<p><div>" + "<center>" * 50_000 + "<p></p>" * 50_000, "<title>" * 100_000, "<x></y>" * 100_000, "<li>x" * 100_000, "<!--" * 200_000, "word " * 1_000_000):
        html_extract.main_text(page, crf)
    assert time.monotonic() - began < 120


# URL rules


def test_url_parts_and_hand_rules(spark):
    urls = ["https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://x.org", "http://x.org/", "https://b.com/fr/1", "https://com/de/", "https://bcom/de/", "nothing", None, "", "a://h?q/://x"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = {r["page_id"]: r for r in url_rules.judge(rows, url_rules.mine(rows.select("url", F.lit(False).alias("block")).where("false"))).collect()}
    got = [(out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) for i in range(len(urls))]
    assert got == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("x.org", "/", "org/", "allow"),
        ("b.com", "/fr/1", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"), ("bcom", "/de/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"),
    ]


def brute_rules(sets, label, n):
    """All combinations of frequent tokens: tokens -> confidence, support, step of its chance (None under the support limit) and whether it passes the other limits."""
    base = sum(label in held for _, held in sets) / n
    where = {t: frozenset(i for i, (own, _) in enumerate(sets) if t in own) for own, _ in sets for t in own}
    where = {t: w for t, w in where.items() if len(w) >= url_rules.MIN_ROWS}
    same = collections.defaultdict(list)
    for t, w in where.items():
        same[w].append(t)
    out = {}
    for own, _ in sets:
        groups = sorted({min(same[where[t]]) for t in own if t in where})
        for k in range(1, len(groups) + 1):
            for combo in itertools.combinations(groups, k):
                at = frozenset.intersection(*(where[t] for t in combo))
                hits = sum(label in sets[i][1] for i in at)
                share = hits / len(at)
                enough = hits >= max(url_rules.MIN_ROWS, url_rules.MIN_SUPPORT * n) and share >= base + url_rules.MIN_GAIN * (1 - base)
                far = sum(len(at) * p * math.log(p / q) for p, q in ((share, base), (1 - share, 1 - base)) if p > 0) if share > base else 0
                key = tuple(sorted(x for t in combo for x in same[where[t]]))
                out[key] = (share, hits, min(int(far / url_rules.STEP), url_rules.STEPS) if hits >= url_rules.MIN_ROWS else None, enough)
    return out


def test_mined_rules_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        site, part = r.choice(("good", "spam", "mixed")), r.choice(("buy", "read"))
        host = r.choice(("", "m.", "www.")) + site + ".net"
        rows.append((f"http://{host}/a/b/c/d/{part}/{i}?q=1&w=2&e=3&r=4&t={i}", site == "spam" or (site == "mixed" and part == "buy"), None if i % 7 else i % 14 == 0, "x"))
    labelled = spark.createDataFrame([*rows, *rows[:50], ("http://x.net/" + "s/" * 3000, False, None, "x"), (None, True, True, "x"), ("no url", True, None, "x")], "url string, block boolean, odd boolean, token string")
    rules = url_rules.mine(labelled, label_cols=("block", "odd"))
    sets = [(set(t), {k for k, v in (("block", b), ("odd", o)) if v} or {"clean"}) for t, b, o in labelled.where("url like '%://%'").dropDuplicates(["url"]).select(url_rules.tokens(F.col("url")), "block", "odd").collect()]
    tried = {label: brute_rules(sets, label, len(sets)) for label in ("block", "odd", "clean")}
    steps = sorted((x[2] for rules_of in tried.values() for x in rules_of.values() if x[2] is not None), reverse=True)
    n_tried = sum(map(len, tried.values()))
    limit = min((s for s in steps if n_tried * math.exp(-url_rules.STEP * s) <= url_rules.MAX_FALSE * sum(x >= s for x in steps)), default=10**9)
    for label in ("block", "odd", "clean"):
        want = {k: x for k, x in tried[label].items() if x[2] is not None and x[2] >= limit and x[3]}
        got = {tuple(x["rule_tokens"]): (x["confidence"], x["support"]) for x in rules.where(F.col("label") == label).collect()}
        assert got.keys() == want.keys() and (want or label == "odd")
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    assert any("part=spam" in x["rule_tokens"] for x in rules.collect())
    tail = "?q=1&w=2&e=3&r=4&t=5"
    pages = spark.createDataFrame([(1, "http://m.spam.net/a/b/c/d/read/9" + tail), (2, "http://good.net/a/b/c/d/buy/9" + tail), (3, "http://mixed.net/a/b/c/d/buy/7" + tail), (4, "http://mixed.net/a/b/c/d/read/7" + tail), (4, "http://mixed.net/a/b/c/d/read/7" + tail)], "page_id long, url string")
    assert sorted((x["page_id"], x["verdict"]) for x in url_rules.judge(pages, rules).collect()) == [(1, "block"), (2, "allow"), (3, "block"), (4, "allow"), (4, "allow")]
    assert url_rules.judge(pages.where("false"), rules).count() == 0 and url_rules.mine(labelled.where("false")).count() == 0


def test_rules_are_mined_from_the_given_tables(spark):
    at = "/root/testdata/sf0.01"
    read = lambda t: spark.read.parquet(f"{at}/{t}.parquet")
    labelled = url_rules.labelled_pages(read("pages"), read("labels"))
    rules = url_rules.mine(labelled, label_cols=("low", "toxic")).collect()
    assert labelled.count() > 50 and all(r["label"] in ("low", "toxic", "clean") for r in rules)


def test_labels_that_do_not_depend_on_urls_give_no_rules(spark):
    """Chance findings are held down whatever the number of combinations: ten tables of noise; a planted rule among noise is found."""
    found = 0
    for seed in range(10):
        r = random.Random(seed)
        rows = [(f"http://h{r.randint(0, 9)}.s{r.randint(0, 9)}.net/p{r.choice('abcdef')}/q{r.choice('uvwxyz')}/{i}", r.random() < 0.25) for i in range(400)]
        found += url_rules.mine(spark.createDataFrame(rows, "url string, block boolean")).count() > 0
    assert found <= 2
    rows += [(f"http://planted.net/pa/{i}", i % 10 > 0) for i in range(40)]
    assert any("host=planted.net" in x["rule_tokens"] for x in url_rules.mine(spark.createDataFrame(rows, "url string, block boolean")).collect())


# licenses


def test_licenses_against_brute_force(spark, empty):
    rows = [
        (1, "x\nReleased under the MIT License.\ny", 0), (2, "MIT-licensed, under the\tMIT\n license!", 0), (3, None, 0), (4, "", 0), (5, "Licensed under CC BY-NC 4.0.", 0), (6, "apache\x00License mit license mit license", 0),
        (7, "licensed by under 4 cc nc 0", 0), (8, "This work is licensed under the GNU General Public License, version 3. mİt license", 0), (9, "no licence here", 0), (1, "x\nReleased under the MIT License.\ny", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    out = license_scan.scan(docs).drop("matches").collect()
    assert len(out) == len(rows)
    tokens = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    text = {i: t for i, t, _ in rows}
    for r in out:
        t = text[r["doc_id"]] or ""
        ws, starts, base = tokens(t), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        best, labels = 0.0, set(base)
        for line in t.split("\n"):
            held = set(tokens(line))
            for label, template in license_scan.TEMPLATES:
                want = set(tokens(template))
                if len(held & want) >= license_scan.THRESHOLD * len(want):
                    best, labels = max(best, len(held & want) / len(want)), labels | {label}
        assert r == (r["doc_id"], len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best)
    assert license_scan.scan(empty).count() == 0


def test_wrapped_license_notices(spark):
    rows = []
    for i, (label, template) in enumerate(license_scan.TEMPLATES):
        for width in (30, 75):
            lines = textwrap.wrap(template, width)
            rows += [(f"{i} {width} {k}", f"Some words before.\n\n{mark}" + f"\n{mark}".join(lines) + "\n\nand after") for k, mark in enumerate(("", "# ", " * ", "// "))]
    scattered = "\n".join(f"{w} filler words between them all" for w in license_scan.TEMPLATES[1][1].split())
    rows += [("scattered", scattered), ("half", "\n".join(license_scan.TEMPLATES[1][1].split()[:11])), ("null", None)]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(out) == len(rows)
    for key, _ in rows[:-3]:
        label = license_scan.TEMPLATES[int(key.split()[0])][0]
        assert label in out[key]["labels"].split(",") and out[key]["score"] == 1.0, key
    assert out["scattered"]["score"] == 0 and out["half"]["score"] == 0 and out["half"]["labels"] == "" and out["null"]["score"] == 0


def test_the_positional_filter_cuts_pairs_and_loses_none(spark):
    r = random.Random(3)
    templates = [("x", " ".join(f"t{i}" for i in range(20))), ("y", " ".join(f"t{i}" for i in range(10, 26)))]
    rows = []
    for i in range(400):
        own = r.sample(range(26), r.randint(2, 26))
        rows.append((i, " ".join([f"t{j}" for j in own] + [f"other{r.randint(0, 99)}" for _ in range(r.randint(0, 20))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = license_scan._template_sets(templates)
    order = license_scan.frequency_order(docs, "text", sorted({w for _, ws in sets for w in ws}))
    index = license_scan.prefix_index(templates, order, 0.8)
    blocks = [(i, 0, sorted(set(t.split())), [order.index(w) for w in set(t.split()) if w in order]) for i, t in rows]
    got = license_scan.candidates(spark.createDataFrame(blocks, "row long, block int, held array<string>, ranks array<int>"), spark.createDataFrame(index, "token string, template int, position int, template_size int, need int, rank int")).collect()
    cut = {(x["row"], x["template"]) for x in got if not x["passes"]}
    passed = {(x["row"], x["template"]) for x in got if x["passes"]}
    want = {(i, n) for i, t in rows for n, (_, ws) in enumerate(sets) if len(set(t.split()) & set(ws)) >= license_scan.needed(len(ws), 0.8)}
    assert want <= passed and len(cut) > 20 and not cut & want


def test_the_sql_of_licenses_knows_wrapped_notices(spark, tmp_path):
    import duckdb

    rows = [(i, "x y z\n" + "\n".join(textwrap.wrap(t, 50)) + "\nand more") for i, (_, t) in enumerate(license_scan.TEMPLATES)] + [(90, None), (91, ""), (91, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(db.sql(license_scan.ORACLES["op9_set_similarity_join"]).fetchall())
    got = sorted(tuple(x) for x in license_scan.op9_set_similarity_join(spark, str(tmp_path)).collect())
    assert got == want and all(x[-1] == 1.0 for x in got if x[0] < 90)


# mixing


def test_targets_against_water_filling(spark):
    r = random.Random(1)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i:02}": r.choice((0, 3, 10, 500, 10_000)) for i in range(n - 1)} | {None: 40}
        names = [*sorted(x for x in sizes if x), None]
        w = {x: 1 + i % 3 for i, x in enumerate(names)}
        want, free, left = {}, set(names), float(sum(sizes.values()))
        while free:
            over = [x for x in free if left * w[x] / sum(w[y] for y in free) > 3 * sizes[x]]
            if not over:
                break
            for x in over:
                want[x] = 3.0 * sizes[x]
            left -= sum(want[x] for x in over)
            free -= set(over)
        want |= {x: left * w[x] / sum(w[y] for y in free) for x in free}
        got = {x["src"]: x["target"] for x in source_mix.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_mix_comes_near_its_targets(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 5 else None, 1) for i in range(3000)] + [(9000 + i, "w " * 4, "hot", 1) for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    out = source_mix.mix(table).withColumn("taken", F.col("times") * F.col("size"))
    for r in out.groupBy("src").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("times").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 7 and r["most"] <= 3
    mixed = source_mix.mixed_documents(table)
    assert mixed.columns == table.columns and sum(len(words(r["text"])) for r in mixed.collect()) == out.agg(F.sum("taken")).first()[0]
    assert sorted(source_mix.mix(docs).select("doc_id", "times").collect()) == sorted(source_mix.mix(docs.repartition(7)).select("doc_id", "times").collect())
    assert source_mix.mix(empty).count() == 0


# language model


def brute_model(texts, order):
    top = collections.Counter()
    for t in texts:
        whole = kneser_ney.START * (order - 1) + t
        top.update(whole[i : i + order] for i in range(len(t)))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = collections.Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [min(i, max(0.05 * i, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[1] else 0.5 * i for i in (1, 2, 3)]

    ds = {k: discounts(c) for k, c in counts.items()}
    totals, offs = collections.Counter(), collections.defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            totals[k, g[:-1]] += n
            offs[k, g[:-1]] += ds[k][min(n, 3) - 1]

    def p(g, k):
        if not k:
            return 1 / (len(counts[1]) + 1)
        ctx = (k, g[:-1])
        if not totals[ctx]:
            return p(g[1:], k - 1)
        n = counts[k][g]
        return (n - ds[k][min(n, 3) - 1] if n else 0) / totals[ctx] + offs[ctx] / totals[ctx] * p(g[1:], k - 1)

    def score(t):
        whole = kneser_ney.START * (order - 1) + t
        return math.exp(-sum(math.log(p(whole[i : i + order], order)) for i in range(len(t))) / len(t))

    return score


def test_kneser_ney_against_brute_force(spark, empty):
    r = random.Random(4)
    text = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 80)))
    rows = [(i, text("abcd e"), "x", 1) for i in range(60)] + [(100 + i, text("xyz é"), None, 1) for i in range(60)] + [(200, "zzzqqq" * 9, "x", 1), (201, None, "x", 1), (202, "", "x", 1), (203, "some", "none", 1), (5, "abc", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    trusted = spark.createDataFrame([(i,) for i in [*range(40), *range(100, 140)]], "doc_id long")
    part = {x["doc_id"] for x in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD_OUT)) != 0).collect()}
    ids = {*range(40), *range(100, 140)} & part
    models = {lang: brute_model([t for i, t, x, _ in rows if i in ids and x == lang and t], 3) for lang in ("x", None)}
    for most in (kneser_ney.MAX_ENTRIES, 0):
        out = kneser_ney.classify(docs, trusted, order=3, max_entries=most).collect()
        assert len(out) == len(rows)
        got = collections.defaultdict(list)
        for x in out:
            got[x["doc_id"]].append((x["perplexity"], x["kept"], x["n_chars"]))
        for i, t, lang, _ in rows:
            if i == 5:
                continue
            perplexity, kept, n = got[i][0]
            assert n == len(t or "")
            if t and lang in models:
                assert abs(perplexity / models[lang](t) - 1) < 1e-9
            else:
                assert perplexity is None and kept == bool(t)
        assert got[200][0][1] is False
    assert kneser_ney.classify(empty, trusted).count() == 0


def test_the_threshold_is_the_quantile_of_held_out_trusted_documents(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choice("abcd e") for _ in range(r.randint(5, 60))), ("x", None)[i % 3 == 0]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {x["doc_id"] for x in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD_OUT)) == 0).collect()}
    out = kneser_ney.classify(docs, docs.select("doc_id").where("doc_id < 100"), order=3, quantile=0.9).collect()
    for lang in ("x", None):
        apart = sorted(x["perplexity"] for x in out if x["lang"] == lang and x["doc_id"] in held and x["doc_id"] < 100)
        assert apart and {x["threshold"] for x in out if x["lang"] == lang} == {apart[math.ceil(0.9 * len(apart)) - 1]}
