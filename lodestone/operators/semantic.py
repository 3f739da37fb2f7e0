"""Hashed embeddings, cosine top-k, and hybrid fusion of full-text and semantic candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.functions import text as T
from lodestone.functions.splitting import pieces

#: Fixed values of the fusion: rank constant, weights of the two rank terms and of the three signals.
RANK_CONSTANT, W_LEXICAL, W_SEMANTIC, W_EXACT, W_PATH, W_RECENCY = 60, 0.45, 0.35, 0.10, 0.05, 0.05


#: Query vectors that are sent to the tasks at a time.
QUERY_BLOCK = 4096
#: Bytes of texts whose trigrams are counted at a time.
TRIGRAM_CHARS = 2_000_000


def features(rows: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """Signed sums by bucket: id, bucket, value. terms: array<struct<term, weight>>.

    A row's terms are made and partially summed where the row is; only its buckets are exchanged."""
    t = rows.select(id_col, F.explode(terms).alias("t"))
    signed = T.hash_sign(F.col("t.term")) * F.col("t.weight")
    return t.groupBy(id_col, T.hash_bucket(F.col("t.term")).alias("bucket")).agg(F.sum(signed).alias("value"))


def unit(features: DataFrame, id_col: str) -> DataFrame:
    """L2-normalised values; a vector of norm 0 stays."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(id_col)))
    return features.withColumn("value", F.when(norm > 2.220446049250313e-16, F.col("value") / norm).otherwise(F.col("value")))


def trigram_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """gram and n: how often each three characters stand in the texts, A-Z lower-cased, by `text.char_trigrams`. About TRIGRAM_CHARS characters are
    counted at a time in arrays, so that distinct trigrams of these are added up and exchanged in place of every single one."""

    def counted(texts):
        size = np.array([len(x) for x in texts], np.int64)
        at = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.where((at >= 65) & (at <= 90), at + 32, at)
        letters = np.flatnonzero(np.bincount(at)) if len(at) else at
        code, k = np.searchsorted(letters, at), len(letters)
        inside = np.ones(len(at), bool)
        ends = np.cumsum(size)
        inside[ends[size > 0] - 1] = inside[(ends - 2)[size > 1]] = False
        first = np.flatnonzero(inside)
        gram = (code[first] * k + code[first + 1]) * k + code[first + 2]
        if k**3 <= len(gram):
            n = np.bincount(gram)
            gram = np.flatnonzero(n)
            n = n[gram]
        else:
            gram, n = np.unique(gram, return_counts=True)
        joined = letters[np.stack([gram // (k * k), gram // k % k, gram % k], axis=1).ravel()].astype("<u4").tobytes().decode("utf-32-le") if len(gram) else ""
        return pa.RecordBatch.from_arrays([pa.array([joined[i : i + 3] for i in range(0, len(joined), 3)], pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

    def run(batches):
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in pieces(np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64) + 1, TRIGRAM_CHARS):
                yield counted([x or "" for x in texts.slice(lo, hi - lo).to_pylist()])

    return rows.select(text_col).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def query_features(text: str) -> list[tuple[int, float]]:
    """The hashed embedding of a query on the driver: bucket and unit value."""
    import hashlib
    import re

    tokens = re.findall(r"[^\W_]+", text.lower())
    sums: dict[int, float] = {}
    for term, weight in [(t, 1.0) for t in tokens] + [(f"{a} {b}", 0.5) for a, b in zip(tokens, tokens[1:], strict=False)]:
        d = hashlib.sha256(term.encode()).digest()
        sums[d[0] % T.DIMENSION] = sums.get(d[0] % T.DIMENSION, 0.0) + (weight if d[8] % 2 == 0 else -weight)
    norm = sum(v * v for v in sums.values()) ** 0.5
    return [(b, v / norm if norm > 2.220446049250313e-16 else v) for b, v in sorted(sums.items())]


def semantic_search(vectors: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """vectors: passage_id, embedding (stored, of norm 1 or 0). Best cosine first, then passage id; ranks from 1. One pass, without
    an exchange but for the best `limit` of each task."""
    query = [0.0] * T.DIMENSION
    for bucket, value in query_features(text):
        query[bucket] = value
    scored = vectors.select("passage_id", T.cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("similarity"))
    order = [F.round("similarity", 9).desc(), F.col("passage_id")]
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def vector_topk(vectors: DataFrame, queries: DataFrame, limit: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
    """vectors: vec_id, embedding; queries: query_id, q. For each query the best by exact cosine, then by id.

    Queries are sent in blocks of at most `block` vectors, each against all vectors where these are; a task
    leaves its best `limit` of each query, so what is exchanged is bounded by queries, limit and tasks. A vector or
    query that is null, of another length or of norm 0 has no similarity and comes last."""
    spark = vectors.sparkSession
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "vec_id": vectors.schema["vec_id"].dataType.simpleString()}
    n_blocks = -(-queries.count() // block)
    named = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id", "q"), F.lit(max(n_blocks, 1))).alias("of"))
    schema = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, similarity double"
    found, wire = spark.createDataFrame([], schema), to_arrow_schema(StructType.fromDDL(schema))
    for i in range(n_blocks):
        rows = named.where(F.col("of") == i).collect() if n_blocks > 1 else named.collect()
        held = spark.sparkContext.broadcast(([r["query_id"] for r in rows], [r["q"] for r in rows]))

        def best(batches, held=held):
            def matrix(lists, width):
                fit = np.array([x is not None and len(x) == width and None not in x for x in lists], bool)
                out = np.full((len(lists), width), np.nan)
                if fit.any():
                    out[fit] = np.array([x for x, ok in zip(lists, fit, strict=True) if ok], np.float64)
                norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
                return out / np.where(norm > 0, norm, np.nan)

            ids, wanted = held.value
            widths = {len(x) for x in wanted if x is not None}
            best_of = {j: ([], np.zeros(0)) for j, x in enumerate(wanted) if x is not None}  # ids and similarities, best first
            for batch in batches:
                vectors, number = batch.column("embedding").to_pylist(), batch.column("vec_id").to_pylist()
                for width in widths:
                    asked = [j for j in best_of if len(wanted[j]) == width]
                    mine = matrix(vectors, width)
                    for lo in range(0, len(asked), 256):
                        some = asked[lo : lo + 256]
                        score = np.round(mine @ matrix([wanted[j] for j in some], width).T, 12)
                        for j, column in zip(some, score.T, strict=True):
                            was, value = best_of[j]
                            rank = -np.nan_to_num(np.round(np.r_[value, column], 9), nan=-2.0)
                            if len(rank) > limit:
                                cut = np.flatnonzero(rank <= np.partition(rank, limit - 1)[limit - 1])
                            else:
                                cut = np.arange(len(rank))
                            name = lambda i, was=was: was[i] if i < len(was) else number[i - len(was)]
                            cut = sorted(cut.tolist(), key=lambda i: (rank[i], (n := name(i)) is None, n or 0))[:limit]
                            best_of[j] = ([name(i) for i in cut], np.r_[value, column][cut])
            for j, (own, value) in best_of.items():
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[j]] * len(own), wire.field(0).type), pa.array(own, wire.field(1).type), pa.array(value, mask=np.isnan(value))], schema=wire)

        found = found.union(vectors.select("vec_id", "embedding").mapInArrow(best, schema))
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def reciprocal(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.0).otherwise(1 / (RANK_CONSTANT + F.greatest(rank, F.lit(1))))


def fuse(candidates: DataFrame, query: str) -> DataFrame:
    """candidates: passage_id, lexical_rank, semantic_rank, passage_text, title, source_uri, mtime_ns (few rows: two bounded lists).

    Semantic-only candidates need half of the query's words; recency is scaled over those admitted."""
    q = T.normalize_fusion(F.lit(query))
    words = F.array_distinct(F.split(q, " "))
    evidence = T.token_set(F.concat_ws(" ", "passage_text", "title", "source_uri"))
    admitted = F.col("lexical_rank").isNotNull() | (F.size(F.array_intersect(words, evidence)) * 2 >= F.size(words))
    rows = candidates.where(admitted)
    exact = F.contains(T.normalize_fusion(F.col("passage_text")), q) | F.contains(T.normalize_fusion(F.col("title")), q) | F.contains(T.normalize_fusion(F.col("source_uri")), q)
    path = F.size(F.array_intersect(words, T.token_set(F.concat_ws(" ", "title", "source_uri")))) / F.size(words)
    every = Window.partitionBy()
    lo, hi = F.min("mtime_ns").over(every), F.max("mtime_ns").over(every)
    recency = F.when(F.col("mtime_ns").isNull(), 0.0).when(lo == hi, 1.0).otherwise((F.col("mtime_ns") - lo).cast("double") / (hi - lo).cast("double"))
    rows = rows.withColumns({"lexical_rrf": reciprocal(F.col("lexical_rank")), "semantic_rrf": reciprocal(F.col("semantic_rank")), "exact_match": exact, "path_overlap": path, "recency": recency})
    metadata = W_EXACT * F.col("exact_match").cast("double") + W_PATH * F.col("path_overlap") + W_RECENCY * F.col("recency")
    rows = rows.withColumn("score", W_LEXICAL * F.col("lexical_rrf") + W_SEMANTIC * F.col("semantic_rrf") + metadata)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "passage_id")).cast("long"))


def hybrid_candidates(lexical: DataFrame, semantic: DataFrame, passages: DataFrame) -> DataFrame:
    """Full outer merge of the two bounded lists by passage, with the passages' columns."""
    a = lexical.select("passage_id", F.col("rank").alias("lexical_rank"))
    b = semantic.select("passage_id", F.col("rank").alias("semantic_rank"))
    both = a.join(b, "passage_id", "full_outer")
    return both.join(passages.select("passage_id", "passage_text", "title", "source_uri", "mtime_ns"), "passage_id")


def candidate_limit(limit: int) -> int:
    return max(limit, min(4 * limit, 100))
