"""Stored vectors: refresh by change sets, hash residual, status; and the batched search with its best of each task."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import semantic
from lodestone.operators.vectors import VectorStore, embedded

SCHEMA = "passage_id string, artifact_id long, passage_text string"


def rows(n=60, seed=1):
    r = random.Random(seed)
    return [(f"{i // 2}:{i % 2}", i // 2, " ".join(r.choice("alpha Beta über the of x1 x2 日本".split()) for _ in range(r.randint(0, 20)))) for i in range(n)]


def test_vectors_equal_the_column_expression(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = {}
    for r in semantic.unit(semantic.features(df, "passage_id", T.hash_features(F.col("passage_text"))), "passage_id").collect():
        want.setdefault(r["passage_id"], [0.0] * T.DIMENSION)[r["bucket"]] = r["value"]
    for r in embedded(df.repartition(3)).collect():
        assert all(math.isclose(a, b, abs_tol=1e-7) for a, b in zip(r["embedding"], want.get(r["passage_id"], [0.0] * T.DIMENSION), strict=True))


def test_a_refresh_rewrites_only_what_a_change_touches(spark, tmp_path):
    own = rows()
    store = VectorStore(spark, str(tmp_path / "v"), 8).refresh(spark.createDataFrame(own, SCHEMA), "one")
    first = dict(store.state["buckets"])
    changed = [(p, a, t + " more" if p == "7:1" else t) for p, a, t in own]
    df = spark.createDataFrame(changed, SCHEMA)
    assert [(r["passage_id"], r["why"]) for r in store.changes(df).collect()] == [("7:1", "changed")]
    status = store.status(df).first()
    assert not status["healthy"] and status["violations"] == "text hash differs"
    assert store.current(df).count() == len(own) - 1  # the old vector of the changed text is not read
    store = VectorStore(spark, store.path).refresh(df, "two")
    assert sum(store.state["buckets"][b] != f for b, f in first.items()) == 1 and store.state["source"] == "two"
    assert store.status(df).first()["healthy"] and store.current(df).count() == len(own)
    fewer = df.where("artifact_id < 20")
    assert {r["why"] for r in store.changes(fewer).collect()} == {"gone"}
    assert store.refresh(fewer).status(fewer).first()["healthy"] and store.stored().count() == 40
    same = dict(store.state["buckets"])
    assert store.refresh(fewer).state["buckets"] == same
    store.drop()
    assert VectorStore(spark, store.path).stored().count() == 0 and store.status(fewer).first()["violations"] == "vector is absent"
    assert store.refresh(fewer).status(fewer).first()["healthy"]


def test_an_empty_source(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    store = VectorStore(spark, str(tmp_path / "v")).refresh(empty)
    assert store.stored().count() == 0 and store.status(empty).first()["healthy"]


def test_topk_over_several_batches_of_a_task(spark):
    r = random.Random(2)
    vectors = [(i, [float(r.randint(-1, 1)) for _ in range(4)]) for i in range(400)] + [(None, [1.0, 0.0, 0.0, 0.0]), (900, None), (901, [0.0] * 4), (902, [1.0])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(2)
        queries = spark.createDataFrame([(1, [1.0, 0.0, 1.0, 0.0]), (2, [0.0, -1.0, 0.0, 0.0]), (3, [1.0])], "query_id int, q array<float>")
        found = sorted((x["query_id"], x["rank"], x["vec_id"]) for x in semantic.vector_topk(df, queries, 9).where("similarity is not null").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else None

    want = []
    for q, v in ((1, [1.0, 0.0, 1.0, 0.0]), (2, [0.0, -1.0, 0.0, 0.0]), (3, [1.0])):
        some = [(-round(c, 9), i is not None, i or 0, i) for i, x in vectors if x and len(x) == len(v) and (c := cosine(x, v)) is not None]
        want += [(q, k, i) for k, (_, _, _, i) in enumerate(sorted(some)[:9], 1)]
    assert [x for x in found if x[2] is not None] == [x for x in sorted(want, key=lambda x: (x[0], x[1])) if x[2] is not None]


@pytest.mark.parametrize("most", [2_000_000, 30])
def test_trigrams_are_counted_before_they_are_exchanged(spark, monkeypatch, most):
    """Against a count in Python: short, empty and null texts, characters outside the base plane; no trigram goes over a text's end."""
    monkeypatch.setattr(semantic, "TRIGRAM_CHARS", most)
    texts = [None, "", "a", "aB", "ABC", "abcabc", "\U0001f600é\0x\U0001f600é\0", "aaaa" * 50, "İSTANBUL ÀÉ", "z\u0000y"]
    want = collections.Counter(low[i : i + 3] for t in texts if t for low in [t.translate({c: c + 32 for c in range(65, 91)})] for i in range(len(low) - 2))
    counted = semantic.trigram_counts(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t")
    assert {r["gram"]: r["n"] for r in counted.collect()} == want
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_pairs_are_made_beside_their_hashes(spark):
    """Only tokens go to Python, and only the kept columns come back, with the same vectors."""
    df = spark.createDataFrame([("1:0", 1, "a b a b c"), ("2:0", 2, ""), ("3:0", 3, "a"), ("4:0", 4, "c c c a")], SCHEMA).coalesce(1)
    some = embedded(df, keep=["passage_id"])
    assert some.columns == ["passage_id", "embedding"] and "__pairs" not in some._jdf.queryExecution().toString()
    assert {r["passage_id"]: r["embedding"] for r in some.collect()} == {r["passage_id"]: r["embedding"] for r in embedded(df).collect()}
