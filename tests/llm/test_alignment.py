"""Cross-tokenizer alignment against a brute-force version with the vocabularies' own libraries."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, token_alignment
from lodestone.llm.token_alignment import FILE_A, FILE_B, TOKENIZERS

TEXTS = [
    "The quick brown fox, jumping over 12345 lazy dogs.", "the the the the", "", None, " ", "\n\n\t x", "naïve café œuvre, größte Straße", "日本語のテキスト と emoji 🎉🎉", "▁ the piece mark",
    "<|endoftext|></s><s>[INST]", "a\u0000b", "x" * 300, "def f(x):\r\n    return x  # done", "é ​   ﻿", "<0x41>", "of the and of the", "The quick brown fox, jumping over 12345 lazy dogs.",
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(f"{TOKENIZERS}/{FILE_A}")
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{FILE_B}")
    plain = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            byte[chr(256 + len(byte) - len(plain))] = b
    as_a = lambda i: bytes(byte[c] for c in ta.id_to_token(i))
    as_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], collections.Counter()
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        pa, pb = [as_a(i) for i in a], [as_b(i) for i in b]
        if not text or b"".join(pa) != whole or b"".join(pb) != whole:
            docs.append((doc_id, [], collections.Counter(), 0, 0))
            continue
        ea, eb = np.cumsum([len(x) for x in pa]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
        groups, found, lo_a, lo_b = [], collections.Counter(), 0, 0
        for end in sorted(set(ea) & set(eb)):
            hi_a, hi_b = ea.index(end) + 1, eb.index(end) + 1
            groups.append((a[lo_a:hi_a], b[lo_b:hi_b]))
            found.update((x, y) for x in a[lo_a:hi_a] for y in b[lo_b:hi_b])
            lo_a, lo_b = hi_a, hi_b
        count.update(found.keys())
        docs.append((doc_id, groups, found, len(a), len(b)))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups, found, n_a, n_b in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), sum(found.values()), sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items()), sha))
    return out, count, best


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["alpha", "Beta", "über", "naïve", "the", "of", "x1", "tokenization", "日本", "\n", "..."]
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]
    made.append(" ".join(r.choice(words) for _ in range(20_000)))
    out = list(enumerate([*TEXTS, *made]))
    return [*out, out[0], (None, "the null id")]


def as_rows(found):
    return sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr)


def test_alignment_agrees_with_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, n_a string, block int").repartition(3)
    want, _, _ = brute(rows)
    assert as_rows(token_alignment.align(docs).collect()) == sorted(want, key=repr)


def test_small_blocks_stripes_and_shares_give_the_same(spark, rows):
    """Everything is cut as finely as it can be."""
    fine = token_alignment.Sizes(stripes=5, block_bytes=400, block_docs=4, chunk=16, held=50, cells=7, links=100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want, count, best = brute(rows)
    blocks = common.staged(token_alignment.encoded(docs, sizes=fine), "test-blocks")
    matrix = common.staged(token_alignment.count_matrix(blocks, sizes=fine), "test-counts")
    assert {(r["a"], r["b"]): (r["count"], r["best"]) for r in token_alignment.pair_counts(matrix, sizes=fine).collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}
    assert as_rows(token_alignment.scored(blocks, matrix, sizes=fine).collect()) == sorted(want, key=repr)


def test_one_group_larger_than_a_chunk():
    v = token_alignment.vocabulary(TOKENIZERS)
    a, b = np.array([5, 6, 5, 7, 8]), np.array([3, 4, 3, 9])
    groups = (a, b, np.zeros(5, int), np.zeros(4, int), np.array([5]), np.array([4]), None, None, None)
    key, times = token_alignment.links(v, groups, np.array([2]), 128, 10)
    width = (v.size_a // 128 + 1) * v.size_b
    pairs = [((int(k >> 16) % width) // v.size_b * 128 + int(k >> 16) // width, int(k >> 16) % width % v.size_b, int(k & 0xFFFF)) for k in key]
    want = collections.Counter((int(x), int(y), 2) for x in a for y in b)
    assert dict(zip(pairs, times.tolist(), strict=True)) == want and len(key) == len(want)


def test_groups_are_given_when_asked_for(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in token_alignment.align(docs, with_groups=True).collect()}
    assert hashlib.sha256(out[1]["groups"].encode()).hexdigest() == out[1]["groups_sha256"] and out[1]["groups"].count("|") == out[1]["n_groups"]
    assert out[2]["groups"] is None and out[2]["groups_sha256"] == "" and out[2]["n_links"] == 0


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merges_agree_with_the_vocabularys_own_library_on_every_code_point():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{TOKENIZERS}/{FILE_A}")
    own.encode_special_tokens = True
    v = token_alignment.vocabulary(TOKENIZERS)
    for lo in range(0, 0x110000, 4096):
        texts = [f" a{c}b {c}{c} 1{c}2 !{c}! {c}a{c}1" for c in map(chr, range(lo, lo + 4096)) if not 0xD800 <= ord(c) < 0xE000]
        if texts:
            assert [x.ids for x in own.encode_batch(texts, add_special_tokens=False)] == [v.a.encode_ordinary(x) for x in texts]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _, _ = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert as_rows(token_alignment.op12_dense_alignment(spark, sf_dir).collect()) == sorted(want, key=repr)
    assert docs.where(F.col("text").isNull()).count() == sum(1 for x in want if x[1] == 0 and x[7] == "") or want
