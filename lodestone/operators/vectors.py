"""Stored vectors of passages, kept up to date by change sets.

Vectors stand in buckets of artifacts, each bucket in a folder of its own that is named by the manifest. A refresh compares (passage, text hash) of the
source with what is stored, makes vectors of the passages that are new or changed, and rewrites the buckets that a change falls
into: their other vectors are copied. Then the manifest is replaced by a rename, so readers see the state before or after. A
vector carries the hash of the text it was made from, and reads take only those whose hash is still that of the passage.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.splitting import pieces
from lodestone.plans import generations

BUCKETS, BIGRAM_WEIGHT = 64, 0.5
CONFIG = {"provider": "hash-token-bigram", "dimension": T.DIMENSION, "normalization": "l2", "tokenizer": "unicode-alnum-lower", "weights": f"token=1.0;bigram={BIGRAM_WEIGHT}"}
#: Tokens that are hashed at a time.
PIECE_TOKENS = 500_000
ROWS = "passage_id string, artifact_id long, text_hash string, embedding array<float>"


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def embedded(rows: DataFrame, text_col: str = "passage_text", out: str = "embedding", dimension: int = T.DIMENSION, keep: list[str] | None = None) -> DataFrame:
    """Adds the hashed embedding of a text: signed sums of tokens and bigrams by bucket, L2-normalised, as floats. keep: the columns that stay, else all.
    The distinct terms and pairs of PIECE_TOKENS tokens are hashed once; no row leaves its task."""
    names = rows.columns if keep is None else keep
    df = rows.select(*names, T.tokenize_alnum(F.col(text_col)).alias("__terms"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + f", {out} array<float>"

    def added(sums, row, terms, code, weight):
        digests = [hashlib.sha256(t.encode()).digest() for t in terms]
        bucket = np.array([d[0] % dimension for d in digests], np.int64)
        signed = np.array([weight * (1.0 - 2.0 * (d[8] % 2)) for d in digests])
        return sums + np.bincount(row * dimension + bucket[code], signed[code], sums.size).reshape(sums.shape) if len(code) else sums

    def vectors(lists):
        row = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
        flat = lists.flatten().dictionary_encode()
        words, code = flat.dictionary.to_pylist(), np.asarray(flat.indices).astype(np.int64)
        sums = added(np.zeros((len(lists), dimension)), row, words, code, 1.0)
        both = np.flatnonzero(row[1:] == row[:-1])
        pairs, pair = np.unique(code[both] * max(1, len(words)) + code[both + 1], return_inverse=True)
        sums = added(sums, row[both], [f"{words[a]} {words[b]}" for a, b in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(words)))), strict=True)], pair, BIGRAM_WEIGHT)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        value = (sums / np.where(norm > 2.220446049250313e-16, norm, 1.0)).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dimension, pa.int32()), pa.array(value.ravel()))

    def run(batches):
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column("__terms")).fill_null(0)).astype(np.int64)
            for lo, hi in pieces(size + 1, PIECE_TOKENS):
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), vectors(some.column("__terms"))], [*names, out])

    return df.mapInArrow(run, schema)


class VectorStore:
    """The vectors under a path, as its manifest was when the instance was made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.state = generations.manifest(spark, path) or {"config": CONFIG, "count": buckets, "buckets": {}, "rows": 0, "source": None}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("artifact_id"), F.lit(self.state["count"])).cast("int")

    def stored(self, buckets: list[str] | None = None) -> DataFrame:
        """All stored vectors, or those of some buckets."""
        folders = [f for b, f in self.state["buckets"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(ROWS).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], ROWS)

    def changes(self, passages: DataFrame) -> DataFrame:
        """passages: passage_id, artifact_id, passage_text. passage_id, artifact_id and why: changed, gone or absent."""
        source = passages.select("passage_id", "artifact_id", text_hash(F.col("passage_text")).alias("now"))
        held = self.stored().select("passage_id", F.col("artifact_id").alias("a"), F.col("text_hash").alias("made"))
        why = F.when(F.col("now").isNull(), "gone").when(F.col("made").isNull(), "absent").when(F.col("made") != F.col("now"), "changed")
        both = source.join(held, "passage_id", "full_outer").select("passage_id", F.coalesce("artifact_id", "a").alias("artifact_id"), why.alias("why"))
        return both.where("why is not null")

    def refresh(self, passages: DataFrame, source: str | None = None) -> VectorStore:
        """Bring the vectors in line with the passages; buckets without a change keep their folders."""
        rows = passages.select("passage_id", "artifact_id", "passage_text")
        if self.state["buckets"]:
            touched = sorted(r[0] for r in self.changes(rows).select(self._bucket()).distinct().collect())  # at most `count`
            if not touched:
                return self._publish(self.state["buckets"], source)
            rows = rows.where(self._bucket().isin(touched))
            old = self.stored([str(b) for b in touched])
        else:
            touched, old = None, None
        rows = rows.withColumn("text_hash", text_hash(F.col("passage_text")))
        kept = ["passage_id", "artifact_id", "text_hash"]
        if old is None:
            new = embedded(rows, keep=kept)
        else:
            fresh = embedded(rows.join(old, ["passage_id", "text_hash"], "left_anti"), keep=kept)
            same = old.join(rows.select("passage_id", "text_hash"), ["passage_id", "text_hash"], "left_semi")
            new = fresh.select(*same.columns).union(same)
        name = f"vectors-{uuid.uuid4().hex[:12]}"
        out = new.select("passage_id", "artifact_id", "text_hash", "embedding", self._bucket().alias("bucket"))
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        made = {str(r[0]) for r in self.spark.read.schema(f"{ROWS}, bucket int").parquet(f"{self.path}/{name}").select("bucket").distinct().collect()}
        held = {b: f for b, f in self.state["buckets"].items() if touched is not None and int(b) not in touched}
        return self._publish(held | {b: f"{name}/bucket={b}" for b in made}, source)

    def _publish(self, buckets: dict, source: str | None) -> VectorStore:
        self.state = self.state | {"buckets": buckets, "source": source}
        self.state["rows"] = self.stored().count()
        generations.replace_manifest(self.spark, self.path, self.state)
        return self

    def drop(self) -> None:
        generations.drop(self.spark, self.path)
        self.state = self.state | {"buckets": {}, "rows": 0, "source": None}

    def current(self, passages: DataFrame) -> DataFrame:
        """The passages (their columns, but for the text) with their vectors; those whose text is another one now have none and are left out."""
        p = passages.withColumn("text_hash", text_hash(F.col("passage_text"))).drop("passage_text")
        return p.join(self.stored().drop("artifact_id"), ["passage_id", "text_hash"])

    def status(self, passages: DataFrame) -> DataFrame:
        """One row: vectors, passages, vector_bytes, violations (joined by "; ") and healthy."""
        v = self.stored().agg(
            F.count("*").alias("vectors"), F.count_distinct("passage_id").alias("ids"), F.count_if(F.size("embedding") != T.DIMENSION).alias("bad_size"),
            F.count_if(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"),
            F.count_if(F.abs(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x) - 1) > 1e-5).alias("not_unit"),
        )
        c = self.changes(passages).agg(*(F.count_if(F.col("why") == w).alias(w) for w in ("changed", "gone", "absent")))
        n = passages.agg(F.count("*").alias("passages"))
        s = v.crossJoin(c).crossJoin(n)  # one row each
        wrong = F.concat_ws(
            "; ", F.when(F.lit(self.state["config"] != CONFIG), "configuration differs"), F.when(F.col("vectors") != self.state["rows"], "row count differs from the manifest"), F.when(F.col("ids") != F.col("vectors"), "vector id repeats"),
            F.when(F.col("bad_size") > 0, "vector size differs"), F.when(F.col("not_finite") > 0, "vector is not finite"), F.when(F.col("changed") > 0, "text hash differs"), F.when(F.col("gone") > 0, "passage is gone"), F.when(F.col("absent") > 0, "vector is absent"),
        )
        return s.select("vectors", "passages", "not_unit", (F.col("vectors") * T.DIMENSION * 4).alias("vector_bytes"), wrong.alias("violations"), (wrong == "").alias("healthy"))
