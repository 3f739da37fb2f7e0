"""The pipeline against plain Python, stage by stage, and the registry."""

import collections
import random
import re

import __spark_entry__
import corpus_pipeline
from lodestone.llm import common, registry
from tests.llm.test_operators import DOCS, brute_components, brute_repeats, documents


def test_stages_against_brute_force(spark, tmp_path):
    rows = [r for r in documents(80) if r[1] is None or len(r[1]) < 20_000]
    item = " ".join(f"b{i}" for i in range(30))
    rows += [(500, f"{' '.join(f'u{i}' for i in range(40))} {item}", "en", "src1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, docs = str(tmp_path), common.table(spark, str(tmp_path), "documents")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, d), name)
        held.append([tuple(r)[:5] for r in docs.collect()])
        if name != "sharding":
            assert docs.columns == columns

    def passes(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        covered, longest = brute_repeats(ws, 5)
        return len(ws) >= 20 and 100 * brute_repeats(ws, 8)[0] <= 30 * len(ws) and 100 * covered <= 25 * len(ws) and longest <= 64

    key = lambda r: (r[0], r[1])
    want = sorted((r for r in rows if passes(r[1])), key=key)
    assert sorted(held[0], key=key) == want
    least = brute_components(want, 2)
    want = [r for r in want if least[r[0]][1] == r[0]]
    assert sorted(held[1], key=key) == want
    want = [r for r in want if item not in r[1]]
    assert sorted(held[2], key=key) == want and 500 not in {r[0] for r in want}
    times = collections.Counter(r[0] for r in held[3])
    assert set(times) <= {r[0] for r in want} and max(times.values()) <= 3
    assert sorted(held[4], key=key) == sorted(held[3], key=key)
    by = collections.defaultdict(list)
    for r in docs.collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))


def test_stages_on_empty_tables_and_null_rows(spark, tmp_path):
    """No documents give no rows; documents without text or words are refused by the rules; an empty benchmark removes nothing."""
    good = " ".join(f"w{i}" for i in range(40))
    for name, rows, want in (("none", [], []), ("odd", [(None, None, None, None, None), (1, "", "en", None, 0), (2, good, None, None, None), (None, good + " x y z v u " * 3, None, "s", 1)], [2])):
        where = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        out = corpus_pipeline.run(spark, where).collect()
        assert sorted({r["doc_id"] for r in out if r["doc_id"] is not None}) == want


def test_near_copies_are_caught(spark):
    """1 to 5 % of the words changed, in texts of 30 to 400 words: at least 0.9 of the copies go, and no other text."""
    r = random.Random(8)
    rows = []
    for i in range(160):
        n = (30, 60, 100, 200, 400)[i % 5]
        words = [f"v{r.randint(0, 10**8)}" for _ in range(n)]
        copy = list(words)
        for at in r.sample(range(n), max(1, round(n * (1 + i % 5) / 100))):
            copy[at] = f"other{i}x{at}"
        rows += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(copy), "en", "s", 0)]
    kept = {x["doc_id"] for x in corpus_pipeline.dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert {2 * i for i in range(160)} <= kept and len(kept) - 160 <= 16


def test_every_operator_is_registered():
    names = {int(k[2:].split("_")[0]) for k in registry.queries()}
    assert names == set(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and set(registry.oracle_sql()) <= set(registry.queries())
