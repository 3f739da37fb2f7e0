"""Registered queries on embeddings, hybrid ranking and evaluation, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import splitting
from lodestone.functions import text as T
from lodestone.operators import evaluation, lexical, semantic
from lodestone.operators.vectors import VectorStore
from lodestone.plans import canonical as C
from lodestone.plans import stored
from lodestone.plans.storage import shared_dir
from lodestone.queries_search import _sql_hits

QUERY, LIMIT = "of the", 10


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored.vectors(spark, sf_dir).stored().select("passage_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0")
    return v.select("passage_id", "bucket", F.round(F.col("value").cast("double"), 6).alias("value"))


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active passages with the vectors of their texts."""
    p = stored.text_index(spark, sf_dir).passages().where("enabled").select("passage_id", "passage_text")
    return stored.vectors(spark, sf_dir).current(p)


def token_count_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.passages(spark, sf_dir).select("passage_id", F.explode(T.tokenize_alnum(F.col("passage_text"))).alias("t"))
    return p.groupBy("passage_id", T.hash_bucket(F.col("t")).alias("bucket")).agg(F.count("*").alias("n"))


def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.trigram_counts(C.passages(spark, sf_dir), "passage_text").select(F.sha2("gram", 256).alias("gram_hash"), "n")


def provider_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and vector bytes of each embedding provider."""
    n = C.active(C.artifacts(spark, sf_dir)).agg(F.coalesce(F.sum(splitting.passage_count(F.col("text"))), F.lit(0)).alias("samples"))
    names = F.explode(F.array(*(F.lit(x) for x in ("char_trigram", "token_bigram", "token_count"))))
    return n.select(names.alias("provider"), "samples", (F.col("samples") * T.DIMENSION * 4).alias("vector_bytes"))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    v = C.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return semantic.vector_topk(v, q).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.semantic_search(_active(spark, sf_dir), QUERY, LIMIT).select("rank", "passage_id", F.round("similarity", 6).alias("similarity"))


def semantic_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the vectors: count, size, finite values, unit-free labels; violated ones joined by "; "."""
    v = C.table(spark, sf_dir, "embeddings")
    s = v.agg(F.count("*").alias("vectors"), F.count_if(F.size("embedding") != 64).alias("bad_size"), F.count_if(F.exists("embedding", lambda x: F.isnan(x) | x.isNull())).alias("not_finite"), F.count_distinct("vec_id").alias("ids"))
    wrong = F.concat_ws("; ", F.when(F.col("bad_size") > 0, "vector size differs"), F.when(F.col("not_finite") > 0, "vector is not finite"), F.when(F.col("ids") != F.col("vectors"), "vector id repeats"))
    return s.select("vectors", "bad_size", "not_finite", (F.col("vectors") * 64 * 4).alias("vector_bytes"), wrong.alias("violations"), (wrong == "").alias("healthy"))


def vector_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all but src1's passages, src2's of an older text, brought in line with the passages as they are: what the change
    set was, by its kind, and what is left of it afterwards."""
    store = VectorStore(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", 16)
    p = stored.text_index(spark, sf_dir).passages().select("passage_id", "artifact_id", "root", "passage_text")
    old = p.where("root <> 'src1'").withColumn("passage_text", F.when(F.col("root") == "src2", F.concat("passage_text", F.lit(" old"))).otherwise(F.col("passage_text")))
    now = p.where("root <> 'src3'")
    before = store.refresh(old).changes(now).groupBy("why").agg(F.count("*").alias("n"))
    before = before.withColumn("at", F.lit("before"))
    after = VectorStore(spark, store.path).refresh(now).status(now).select(F.when(F.col("healthy"), "healthy").otherwise(F.col("violations")).alias("why"), F.col("vectors").alias("n"), F.lit("after").alias("at"))
    return before.union(after)


def semantic_index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vectors against the passages: counts and violated invariants."""
    return stored.vectors(spark, sf_dir).status(stored.text_index(spark, sf_dir).passages()).drop("not_unit")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = semantic.candidate_limit(LIMIT)
    index = stored.text_index(spark, sf_dir)
    return semantic.hybrid_candidates(index.search(f'"{QUERY}"', k), semantic.semantic_search(_active(spark, sf_dir), QUERY, k), index.passages())


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.fuse(_candidates(spark, sf_dir), QUERY).where(F.col("rank") <= LIMIT).select("rank", "passage_id", F.round("score", 6).alias("score"))


def hybrid_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = semantic.fuse(_candidates(spark, sf_dir), QUERY)
    return f.select("passage_id", "lexical_rank", "semantic_rank", F.round("lexical_rrf", 9).alias("lexical_rrf"), F.round("semantic_rrf", 9).alias("semantic_rrf"), "exact_match", F.round("path_overlap", 6).alias("path_overlap"), F.round("recency", 6).alias("recency"))


def rrf_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).withColumn("s", semantic.W_LEXICAL * semantic.reciprocal(F.col("lexical_rank")) + semantic.W_SEMANTIC * semantic.reciprocal(F.col("semantic_rank")))
    rank = F.row_number().over(Window.orderBy(F.round("s", 12).desc(), "passage_id"))
    return c.select("passage_id", F.round("s", 9).alias("score"), rank.cast("long").alias("rank"))


def recency_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency of each active artifact within its root."""
    a = C.active(C.artifacts(spark, sf_dir))
    w = Window.partitionBy("root")
    lo, hi = F.min("mtime_ns").over(w), F.max("mtime_ns").over(w)
    return a.select("artifact_id", "root", F.round(F.when(lo == hi, 1.0).otherwise((F.col("mtime_ns") - lo).cast("double") / (hi - lo).cast("double")), 6).alias("recency"))


# evaluation: every benchmark item is a query; what is right is where the documents hold it


def _judging(spark: SparkSession, sf_dir: str) -> tuple:
    return stored.text_index(spark, sf_dir), C.artifacts(spark, sf_dir), evaluation.benchmark_items(C.table(spark, sf_dir, "benchmark"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.results(*_judging(spark, sf_dir))


def ablation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, artifacts, items = _judging(spark, sf_dir)
    return evaluation.ablation(index, stored.vectors(spark, sf_dir), artifacts, items)


def anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places where documents hold a benchmark item, and the passages there: which of them cover the place."""
    index, artifacts, items = _judging(spark, sf_dir)
    expected = evaluation.expected_anchors(index, artifacts, items)
    have = index.passages().where("enabled").select("artifact_id", *evaluation.text_anchor(F.col("char_start"), F.col("char_end")))
    met = evaluation.anchors_met(expected, have, ["artifact_id"])
    return met.select("artifact_id", F.col("want.first").alias("first"), F.col("want.last").alias("last"), F.col("have.first").alias("passage_start"), F.col("have.last").alias("passage_end"))


def expected_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.expected_anchors(*_judging(spark, sf_dir)).select("item_id", "artifact_id", "first", "last", "main")


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metrics(_results(spark, sf_dir), [])


def eval_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metrics(_results(spark, sf_dir), ["source_type"])


def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failures(_results(spark, sf_dir))


def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate(evaluation.metrics(_results(spark, sf_dir), []), {"recall_at_1": 0.1, "recall_at_5": 0.1, "mrr": 0.1})


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and nearest-rank p95 of the values of each event type."""
    return evaluation.nearest_rank(C.table(spark, sf_dir, "events"), "event_type", "value", 0.95)


QUERIES = {f.__name__: f for f in (hash_embedding, token_count_embedding, char_trigrams, provider_benchmark, semantic_topk, semantic_search, semantic_status, semantic_index_status, vector_refresh, hybrid_search, hybrid_signals, rrf_only, recency_minmax, eval_metrics, eval_by_class, failure_taxonomy, threshold_gate, ablation_metrics, anchor_match, expected_anchors, latency_percentiles)}

_P = f"WITH RECURSIVE {C.SQL_PASSAGES}"
_BUCKET = "(('0x' || substr(sha256(term), 1, 2))::INTEGER % 128)"
_SIGN = "(CASE WHEN ('0x' || substr(sha256(term), 17, 2))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"


def _features_sql(table: str, key: str, text: str) -> str:
    return f"""ft AS (SELECT {key}, {C.sql_alnum(text)} AS ts FROM {table}),
fe AS (SELECT {key}, unnest(ts) AS term, 1.0::DOUBLE AS w FROM ft UNION ALL SELECT {key}, ts[i] || ' ' || ts[i + 1], 0.5::DOUBLE FROM ft, unnest(range(1, len(ts))) AS t(i)),
fb AS (SELECT {key}, {_BUCKET} AS bucket, sum({_SIGN} * w) AS value FROM fe GROUP BY ALL)"""


_QV = semantic.query_features(QUERY)
_K = semantic.candidate_limit(LIMIT)
_SEMANTIC = f"""{_features_sql("(SELECT * FROM passages WHERE enabled)", "passage_id", "passage_text")},
qv(bucket, q) AS (VALUES {", ".join(f"({b}, {v!r}::DOUBLE)" for b, v in _QV)}),
fu AS (SELECT passage_id, bucket, CASE WHEN n > 2.220446049250313e-16 THEN (value / n)::FLOAT::DOUBLE ELSE value END AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY passage_id)) AS n FROM fb)),
se AS (SELECT passage_id, CASE WHEN sqrt(sum(value * value)) > 2.220446049250313e-16 THEN coalesce(sum(value * q), 0) / sqrt(sum(value * value)) ELSE 0 END AS similarity FROM fu LEFT JOIN qv USING (bucket) GROUP BY passage_id),
sr AS (SELECT *, row_number() OVER (ORDER BY round(similarity, 9) DESC, passage_id) AS rank FROM se)"""
_WORDS = "['" + "', '".join(dict.fromkeys(QUERY.split())) + "']"
_HYBRID = f"""{_sql_hits(f'"{QUERY}"', _K)}, {_SEMANTIC},
cd AS (SELECT coalesce(l.passage_id, s.passage_id) AS passage_id, l.rank AS lexical_rank, s.rank AS semantic_rank FROM (SELECT passage_id, rank FROM hits) l FULL OUTER JOIN (SELECT passage_id, rank FROM sr WHERE rank <= {_K}) s ON l.passage_id = s.passage_id),
ca AS (SELECT cd.*, p.passage_text, p.title, p.source_uri, p.mtime_ns FROM cd JOIN passages p USING (passage_id)),
ad AS (SELECT * FROM ca WHERE lexical_rank IS NOT NULL OR len(list_intersect({_WORDS}, {C.sql_alnum("passage_text || ' ' || title || ' ' || source_uri")})) * 2 >= len({_WORDS})),
sg AS (SELECT *, CASE WHEN lexical_rank IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + lexical_rank) END AS lexical_rrf, CASE WHEN semantic_rank IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + semantic_rank) END AS semantic_rrf,
  contains({C.sql_normalized("passage_text")}, '{QUERY}') OR contains({C.sql_normalized("title")}, '{QUERY}') OR contains({C.sql_normalized("source_uri")}, '{QUERY}') AS exact_match,
  len(list_intersect({_WORDS}, {C.sql_alnum("title || ' ' || source_uri")}))::DOUBLE / len({_WORDS}) AS path_overlap,
  CASE WHEN mtime_ns IS NULL THEN 0 WHEN max(mtime_ns) OVER () = min(mtime_ns) OVER () THEN 1 ELSE (mtime_ns - min(mtime_ns) OVER ())::DOUBLE / (max(mtime_ns) OVER () - min(mtime_ns) OVER ())::DOUBLE END AS recency FROM ad)"""

ORACLES = {
    "hash_embedding": f"{_P}, {_features_sql('passages', 'passage_id', 'passage_text')} SELECT passage_id, bucket::INTEGER AS bucket, round(CASE WHEN sqrt(sum(value * value) OVER (PARTITION BY passage_id)) > 2.220446049250313e-16 THEN (value / sqrt(sum(value * value) OVER (PARTITION BY passage_id)))::FLOAT::DOUBLE ELSE value END, 6) AS value FROM fb WHERE value <> 0",
    "token_count_embedding": f"{_P}, t AS (SELECT passage_id, unnest({C.sql_alnum('passage_text')}) AS term FROM passages) SELECT passage_id, {_BUCKET}::INTEGER AS bucket, count(*) AS n FROM t GROUP BY ALL",
    "char_trigrams": f"{_P} SELECT sha256(substr(t, i, 3)) AS gram_hash, count(*) AS n FROM (SELECT translate(passage_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM passages), unnest(range(1, length(t) - 1)) AS u(i) GROUP BY 1",
    "provider_benchmark": f"{_P} SELECT provider, samples, samples * 512 AS vector_bytes FROM (SELECT count(*) AS samples FROM passages WHERE enabled), (VALUES ('char_trigram'), ('token_bigram'), ('token_count')) v(provider)",
    "semantic_topk": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, round(c, 6) AS similarity FROM r WHERE rank <= 20",
    "semantic_search": f"{_P}, {_SEMANTIC} SELECT rank, passage_id, round(similarity, 6) AS similarity FROM sr WHERE rank <= {LIMIT}",
    "semantic_status": "SELECT count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS bad_size, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS not_finite, count(*) * 256 AS vector_bytes, concat_ws('; ', CASE WHEN count(*) FILTER (len(embedding) <> 64) > 0 THEN 'vector size differs' END, CASE WHEN count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) > 0 THEN 'vector is not finite' END, CASE WHEN count(*) <> count(DISTINCT vec_id) THEN 'vector id repeats' END) AS violations, violations = '' AS healthy FROM embeddings",
    "semantic_index_status": f"{_P} SELECT count(*) AS vectors, count(*) AS passages, count(*) * 512 AS vector_bytes, '' AS violations, true AS healthy FROM passages",
    "vector_refresh": f"{_P} SELECT why, count(*) AS n, 'before' AS at FROM (SELECT CASE root WHEN 'src1' THEN 'absent' WHEN 'src2' THEN 'changed' WHEN 'src3' THEN 'gone' END AS why FROM passages) WHERE why IS NOT NULL GROUP BY why UNION ALL SELECT 'healthy', count(*), 'after' FROM passages WHERE root <> 'src3'",
    "hybrid_search": f"{_HYBRID}, f AS (SELECT passage_id, 0.45::DOUBLE * lexical_rrf + 0.35::DOUBLE * semantic_rrf + 0.1::DOUBLE * exact_match::INTEGER + 0.05::DOUBLE * path_overlap + 0.05::DOUBLE * recency AS score FROM sg), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, passage_id) AS rank FROM f) SELECT rank, passage_id, round(score, 6) AS score FROM r WHERE rank <= {LIMIT}",
    "hybrid_signals": f"{_HYBRID} SELECT passage_id, lexical_rank, semantic_rank, round(lexical_rrf, 9) AS lexical_rrf, round(semantic_rrf, 9) AS semantic_rrf, exact_match, round(path_overlap, 6) AS path_overlap, round(recency, 6) AS recency FROM sg",
    "rrf_only": f"{_HYBRID}, f AS (SELECT passage_id, 0.45::DOUBLE * CASE WHEN lexical_rank IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + lexical_rank) END + 0.35::DOUBLE * CASE WHEN semantic_rank IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + semantic_rank) END AS s FROM ca) SELECT passage_id, round(s, 9) AS score, row_number() OVER (ORDER BY round(s, 12) DESC, passage_id) AS rank FROM f",
    "recency_minmax": f"WITH {C.SQL_ARTIFACTS} SELECT artifact_id, root, round(CASE WHEN max(mtime_ns) OVER w = min(mtime_ns) OVER w THEN 1 ELSE (mtime_ns - min(mtime_ns) OVER w)::DOUBLE / (max(mtime_ns) OVER w - min(mtime_ns) OVER w)::DOUBLE END, 6) AS recency FROM artifacts WHERE enabled WINDOW w AS (PARTITION BY root)",
    **evaluation.sql(), "ablation_metrics": evaluation.ablation_sql(_features_sql),
    "expected_anchors": f"{evaluation._sql_base()} SELECT item_id, artifact_id, first, last, artifact_id = min(artifact_id) OVER (PARTITION BY item_id) AS main FROM ex",
    "anchor_match": f"{evaluation._sql_base()} SELECT artifact_id, first, last, char_start AS passage_start, char_end AS passage_end FROM ex JOIN tk USING (artifact_id) WHERE enabled AND char_start <= first AND char_end >= last",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(list_sort(list(value))[ceil(0.95 * count(value))::INTEGER], 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
}
