"""Sharding: histogram sort.

Rows are ordered by (hash of the text, id, row number). The driver keeps candidate key boundaries
and learns, pass by pass, the exact bytes and rows between them: every partition counts its own
keys against the probes, the counts are summed, and only intervals that hold a shard boundary out
of tolerance, or more rows than a task should get, are probed more finely. An interval also
reports its smallest and largest key, so a hot group (copies of one text, one id) is closed in
on quickly and then cut inside. When all is within tolerance the rows move once, to the piece
(a part of a shard) that their key falls in, and number themselves within it; the exact counts
below each piece give its first slot, so slots are gapless without a global sort.

Equal texts are neighbours in the order, and boundaries inside a group of equal texts are probed
only if the group alone is out of tolerance, so groups stay whole wherever sizes allow.

The driver holds one entry for each probe (4 for each piece and at least FIRST_PROBES), never rows.

Defined results: a null text has size 1 and CRC 0; null ids sort first; repeated rows are told
apart by their row number; an empty table gives an empty table; extra columns stay with their rows
(internal columns are named __ls_...).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common

#: Part of a shard's size by which a boundary may miss its place.
TOLERANCE = 0.0005
#: Most rows that a piece aims at, probes of the first pass, most passes (each narrows an interval at least 64 times).
PIECE_ROWS, FIRST_PROBES, PASSES = 500_000, 4096, 40
KEY = ["__ls_h", "__ls_d", "__ls_u"]


@dataclass
class Interval:
    """Keys in a half-open range: its lower boundary, the smallest and largest key present, rows and bytes."""

    edge: int
    lo: int
    hi: int
    rows: int
    size: int


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The 24-byte keys of a batch; byte order is the order of the signed triples."""
    out = np.empty((batch.num_rows, 3), ">u8")
    for j, name in enumerate(KEY):
        out[:, j] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S24").ravel()


def _packed(probes: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(24, "big") for p in probes], "S24")


def histogram(rows: DataFrame, probes: list[int]) -> list[Interval]:
    """Exact rows and bytes between consecutive probes, with the smallest and largest key of each interval."""
    edges = _packed(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            keys = _keys(batch)
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            keys, size = keys[order], batch.column(batch.schema.get_field_index("__ls_size")).to_numpy(zero_copy_only=False)[order]
            at = np.searchsorted(edges, keys, side="right")
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:], len(at)] - 1
            for i, n, s, lo, hi in zip(at[first].tolist(), (last - first + 1).tolist(), np.add.reduceat(size, first).tolist(), keys[first].tolist(), keys[last].tolist(), strict=True):
                lo, hi = lo.ljust(24, b"\0"), hi.ljust(24, b"\0")
                if i in held:
                    x = held[i]
                    held[i] = [x[0] + n, x[1] + s, min(x[2], lo), max(x[3], hi)]
                else:
                    held[i] = [n, s, lo, hi]
        if held:
            n, s, lo, hi = zip(*held.values(), strict=True)
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(held), pa.int64()), "n": pa.array(n, pa.int64()), "s": pa.array(s, pa.int64()), "lo": pa.array(lo, pa.binary()), "hi": pa.array(hi, pa.binary())})

    sums = rows.select(*KEY, "__ls_size").mapInArrow(count, "i long, n long, s long, lo binary, hi binary")
    found = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    ends = [0, *probes]
    return sorted((Interval(ends[r["i"]], int.from_bytes(r["lo"], "big"), int.from_bytes(r["hi"], "big"), r["n"], r["s"]) for r in found), key=lambda x: x.edge)


def finer(lo: int, hi: int, n: int) -> list[int]:
    """Up to n boundaries inside (lo, hi]: on the first part of the key in which the two differ, so
    that equal texts, then equal ids, stay together as long as possible."""
    shift = 128 if lo >> 128 != hi >> 128 else 64 if lo >> 64 != hi >> 64 else 0
    a, span = lo >> shift, (hi >> shift) - (lo >> shift)
    n = min(n, span)
    return sorted({(a + span * i // n) << shift for i in range(1, n + 1)})


def splitters(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS) -> tuple[list[int], list[int], list[int]]:
    """Boundaries of the pieces (all but the first), the shard of each piece, and its first slot."""
    found = histogram(rows, finer(0, (1 << 192) - 1, FIRST_PROBES))
    total, n_rows = sum(x.size for x in found), sum(x.rows for x in found)
    if not n_rows:
        return [], [0], [0]
    parts = max(n_shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // piece_rows))
    most = max(1, -(-n_rows // parts))
    goals = [total * i / n_shards for i in range(1, n_shards)]
    slack = tolerance * total / n_shards
    for _ in range(PASSES):
        below, todo = 0, []
        for x in found:
            out = any(below + slack < g < below + x.size - slack for g in goals)
            if x.lo < x.hi and (x.rows > most or out):
                todo.append(x)
            below += x.size
        if not todo:
            break
        # counted are the open intervals only: each from its smallest key up to the next interval
        probes, wanted = [], set()
        after = {x.edge: y for x, y in zip(found, [*found[1:], None], strict=True)}
        for x in todo:
            cut = [x.lo, *finer(x.lo, x.hi, max(64, 4 * -(-x.rows // most)))]
            wanted.update(cut)
            probes += cut + ([after[x.edge].lo] if after[x.edge] else [])
        new = [x for x in histogram(rows, sorted(set(probes))) if x.edge in wanted]
        done = {x.edge for x in todo}
        found = sorted([x for x in found if x.edge not in done] + new, key=lambda x: x.lo)
    # each boundary goes where the bytes below come nearest to its goal
    ends = np.cumsum([0] + [x.size for x in found])
    cuts = [int(np.argmin(np.abs(ends - g))) for g in goals]
    shard_of = np.searchsorted(np.array(cuts), np.arange(len(found)), side="right")
    edges, shards, slots, held, slot = [], [], [], most + 1, 0
    for i, x in enumerate(found):
        new_shard = not shards or shard_of[i] != shards[-1]
        if new_shard:
            slot = 0
        if new_shard or held + x.rows > most:
            edges.append(x.lo)
            shards.append(int(shard_of[i]))
            slots.append(slot)
            held = 0
        held += x.rows
        slot += x.rows
    return edges[1:], shards, slots


def shard_rows(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """`df` (its columns `keep`, by default all) with __ls_shard (0 to n_shards - 1) and __ls_slot.

    Shards have nearly equal bytes: UTF-8 bytes of the text plus 1, or size_col."""
    size = df[size_col].cast("long") if size_col else F.coalesce(F.octet_length(df[text_col]), F.lit(0)).cast("long") + 1
    number = F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63))) if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(df[id_col])
    rows = df.withColumns({"__ls_h": F.xxhash64(df[text_col]), "__ls_d": number, "__ls_u": F.monotonically_increasing_id(), "__ls_size": size})
    rows = common.staged(rows.select(*(keep if keep is not None else df.columns), *KEY, "__ls_size"), "shard-rows")
    edges, shards, slots = splitters(rows, n_shards, tolerance, piece_rows)
    packed, shard, slot = _packed(edges), np.array(shards, np.int32), np.array(slots, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(packed, _keys(batch), side="right") if len(packed) else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(shard[at]), pa.array(slot[at])], names=[*batch.schema.names, "__ls_piece", "__ls_shard", "__ls_first"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(place, f"{schema}, __ls_piece int, __ls_shard int, __ls_first long")
    within = Window.partitionBy("__ls_piece").orderBy(*KEY)
    moved = placed.repartitionById(len(shards), "__ls_piece")
    return moved.withColumn("__ls_slot", F.col("__ls_first") + F.row_number().over(within) - 1).drop(*KEY, "__ls_piece", "__ls_first")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    out = shard_rows(docs.withColumn("text_crc32", crc), 8, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", F.col("__ls_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("__ls_shard").alias("shard"), F.col("__ls_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_histogram_sort": op1_histogram_sort}
ORACLES: dict[str, str] = {}
