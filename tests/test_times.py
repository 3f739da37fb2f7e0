"""Artifacts whose modification time is past the nanoseconds that 64 bits hold (ids over 2,088,695): queries that do not show it run as their SQL does."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import queries as library
from lodestone.operators import lexical
from lodestone.plans import canonical as C
from lodestone.plans import stored
from lodestone.plans.query import parse_query
from tests.test_queries import norm

LAST = 2_088_695


@pytest.fixture(scope="module")
def far_dir(sf_dir, tmp_path_factory):
    """60 documents; every other one has an id past LAST."""
    at = tmp_path_factory.mktemp("far")
    duckdb.sql(f"copy (select doc_id + case when doc_id % 2 = 1 then {LAST + 1_000_000} else 0 end as doc_id, * exclude doc_id from '{sf_dir}/documents.parquet' where doc_id < 60) to '{at}/documents.parquet' (format parquet)")
    duckdb.sql(f"copy (select * from '{sf_dir}/benchmark.parquet' order by item_id limit 20) to '{at}/benchmark.parquet' (format parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["fts_vocab_instance", "eval_by_class", "ablation_metrics", "lexical_search"])
def test_query_with_late_artifacts(spark, far_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{far_dir}/{t}.parquet'")
    df = library.queries()[name](spark, far_dir)
    columns = sorted(df.columns)
    want = con.sql(library.oracle_sql()[name])
    names = list(want.columns)
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in want.fetchall())


def test_late_times_are_compared_whole(spark, far_dir):
    p = stored.text_index(spark, far_dir).passages().select("passage_id", "artifact_id", "mtime_ns", "enabled")
    times = {r["passage_id"]: C.EPOCH_NS + r["artifact_id"] * C.HOUR_NS for r in p.collect()}
    assert all(int(r["mtime_ns"]) == times[r["passage_id"]] for r in p.collect()) and max(times.values()) > 2**63
    shown = {r["passage_id"]: r["mtime_ns"] for r in library.queries()["active_passages"](spark, far_dir).collect()}
    assert shown == {r["passage_id"]: t if (t := times[r["passage_id"]]) < 2**63 else None for r in p.where("enabled").collect()}
    after = lexical.filter_conditions(parse_query("the after:2200-01-01").filters)
    assert {r["artifact_id"] for r in p.where(after[0]).collect()} == {r["artifact_id"] for r in p.where(F.col("artifact_id") > LAST).collect()}
    recent = {r["artifact_id"]: r["recency"] for r in library.queries()["recency_minmax"](spark, far_dir).collect()}
    assert max(recent) > LAST and recent[max(recent)] == 1.0
