"""Captured pages: envelopes with a message code, payloads in chunks, field lists."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SNAPSHOT_BYTES, MAX_CHUNK_BYTES = 8 * 1024 * 1024, 160 * 1024


def canonical_json(text: str) -> str:
    """The same value with sorted keys and no spaces."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def code(text: str, key: bytes) -> str:
    return hmac.new(key, canonical_json(text).encode(), hashlib.sha256).hexdigest()


def authenticated(envelopes: DataFrame, key: bytes) -> DataFrame:
    """envelopes: body (JSON), mac (hex) and others. Adds `authentic`; a body that is no JSON is not."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for body, mac in zip(batch.column("body").to_pylist(), batch.column("mac").to_pylist(), strict=True):
                try:
                    out.append(hmac.compare_digest(code(body, key), mac))
                except (ValueError, TypeError):
                    out.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "authentic"])

    return envelopes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in envelopes.schema) + ", authentic boolean")


def field_problem(body: Column, allowed: list[str], required: list[str]) -> Column:
    """unknown_field, missing_field or null."""
    keys = F.json_object_keys(body)
    listed = lambda x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    return F.when(keys.isNull(), "not_an_object").when(F.size(F.array_except(keys, listed(allowed))) > 0, "unknown_field").when(F.size(F.array_except(listed(required), keys)) > 0, "missing_field")


def reassembled(chunks: DataFrame) -> DataFrame:
    """chunks: capture_id, index, total, data (base64), sha256 (of the whole). Payload of each capture, or why there is none.

    A capture's chunks are bounded (MAX_SNAPSHOT_BYTES), so they are joined in one row; sizes are checked on the encoded chunks first."""
    rows = chunks.withColumn("n", F.length("data"))
    whole = rows.groupBy("capture_id").agg(
        F.count("*").alias("n_chunks"), F.count_distinct("index").alias("n_index"), F.max("total").alias("total"), F.min("total").alias("low"), F.max("index").alias("last"),
        F.max("n").alias("largest"), F.sum("n").alias("encoded"), F.min("sha256").alias("sha256"), F.max("sha256").alias("other"),
    )
    problem = (
        F.when((F.col("largest") > MAX_CHUNK_BYTES * 4 // 3 + 4) | (F.col("encoded") > MAX_SNAPSHOT_BYTES * 4 // 3 + 4 * F.col("n_chunks")), "too_large")
        .when((F.col("low") != F.col("total")) | (F.col("n_chunks") != F.col("n_index")) | (F.col("n_chunks") != F.col("total")) | (F.col("last") != F.col("total") - 1) | (F.col("sha256") != F.col("other")), "incomplete")
    )
    state = whole.select("capture_id", "sha256", problem.alias("problem"))
    good = rows.join(state.where("problem is null").select("capture_id"), "capture_id", "left_semi")
    data = good.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("index", F.hex(F.unbase64("data")).alias("h")))).alias("x"))
    data = data.select("capture_id", F.unhex(F.array_join(F.transform("x", lambda c: c["h"]), "")).alias("payload"))
    out = state.join(data, "capture_id", "left")
    wrong = F.coalesce("problem", F.when(F.sha2("payload", 256) != F.col("sha256"), "hash_mismatch"))
    return out.select("capture_id", wrong.alias("problem"), F.when(wrong.isNull(), F.col("payload")).alias("payload"))
