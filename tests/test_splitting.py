"""The linear splitter against the column expression, and on one huge text."""

import random
import time

from pyspark.sql import functions as F

from lodestone.functions import splitting
from lodestone.functions import text as T
from lodestone.plans import canonical


def texts():
    r = random.Random(3)
    pieces = ["word", "é", "🎉", " ", "\n", "\t", " ", "\x1c", "  ", "\n\n", "x" * 40, "日本"]
    out = ["", " ", "\n \n", "x" * 5000, "a" * 1000, "a" * 1001, " " * 2500 + "z", "alpha βeta\n" * 400]
    return out + ["".join(r.choice(pieces) for _ in range(r.randint(0, 900))) for _ in range(40)]


def test_same_passages_as_the_column_expression(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts(), None])], "i int, t string")
    for target, overlap in ((1000, 120), (80, 8), (7, 6), (1, 0)):
        some = df.where(F.length("t") < 1500) if target < 50 else df
        rows = some.select("i", "t", T.split_passages(F.col("t"), target, overlap).alias("a"), splitting.split_passages(F.col("t"), target, overlap).alias("b")).collect()
        for r in rows:
            got = r["b"] or []
            assert [tuple(x) for x in r["a"] or []] == [(x["ordinal"], x["char_start"], x["char_end"], x["text"]) for x in got]
            assert all(x["line_start"] == 1 + r["t"][: x["char_start"]].count("\n") and x["line_end"] == x["line_start"] + x["text"].count("\n") for x in got)


def test_a_huge_text_takes_seconds(spark):
    text = "some words of a line that goes on\n" * 1_500_000
    began = time.time()
    n = spark.createDataFrame([(text,)], "t string").select(F.explode(splitting.split_passages(F.col("t"))).alias("p")).agg(F.count("*").alias("n"), F.max("p.char_end").alias("end"), F.max("p.line_end").alias("line")).first()
    assert n["end"] == len(text) and n["line"] == 1_500_001 and n["n"] > len(text) / 1000
    assert time.time() - began < 60


def test_counts_without_texts_and_pieces_of_a_batch(spark, monkeypatch):
    texts = [None, "", " \n", "a", "a b " * 300, "x" * 5000, "\U0001f600 é\n" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    rows = lambda: {r["i"]: r["p"] for r in df.select("i", splitting.split_passages(F.col("t")).alias("p")).collect()}
    whole = rows()
    monkeypatch.setattr(splitting, "PIECE", 100)
    monkeypatch.setattr(splitting, "_split", _small)
    assert rows() == whole
    found = {r["i"]: r["n"] for r in df.select("i", splitting.passage_count(F.col("t")).alias("n")).collect()}
    assert found == {i: len(p or []) for i, p in whole.items()}


def test_small_tables_are_dealt_without_a_sort(spark):
    df = canonical.spread(spark.range(100).coalesce(1).selectExpr("id", "id % 3 as x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 100
    assert "hashpartitioning(id" in plan and "RoundRobin" not in plan


def _small(texts, *sizes, split=splitting._split):
    """A batch is not made Python strings at once."""
    assert len(texts) < 7
    return split(texts, *sizes)
