"""Suffix-array dedup: every byte covered by a string of `length` bytes that also starts elsewhere.

A window is `length` bytes at a start position. The windows of a text are grouped by anchors, and the
suffixes that start at anchors are sorted:

1. Filter. A window's anchor is its `gram` bytes of least hash (leftmost of equals). Equal windows hold equal anchors
   at equal offsets, so a window can tie only with windows around an equal anchor, and an anchor that occurs once
   drops out with all its windows. Runs of windows with one anchor form an entry (about 1 in 90 bytes), with the
   entry's bytes as its context. Nothing is lost: names are hashes, and equal bytes have equal ones.
2. Range exchange. Entries go to buckets by the bytes of their suffix from the anchor on, against splitters that
   are quantiles of sampled anchors (SAMPLE a bucket, at most MAX_BUCKETS buckets). Equal entries of a task collapse to
   one class with a count first, so copies do not fill a bucket.
3. Local sort. A bucket is read in the order of its leading tokens, SORT_BYTES at a time and a token whole. Multikey
   quicksort (three-way partition by characters of 8 bytes) sorts what stands right of the anchors, and, reversed,
   what stands left of them; the common prefixes of neighbours are compared byte by byte. A window that reaches l
   bytes left and length - l right ties with another where both are in one interval of both orders.
4. Across boundaries. A bucket boundary may cut a run of ties only inside one leading token. Splitters are cut where tokens
   change, so that no tie crosses; a token with more than HOT entries, which may be larger than a bucket, is compared by
   longer tokens instead: its runs are cut at fixed offsets to PART windows, whose common length - PART + 1 bytes are the
   token that deals them, and a token that is still hot is cut to single windows, counted by their bytes with
   partial sums. All ways compare bytes and give the same result.
5. Tied windows go back to the texts as runs, one row for each class, and their union is removed.

Texts, and contexts between the bucket and the text that they came from, are named by 96- and 128-bit digests.

Scale: texts are shuffled once (by text hash), candidates carry about 0.6 of the bytes they mark, all sides
of joins on hot keys are aggregated first or split by adaptive skew handling; the driver holds the sampled tokens,
at most SAMPLE * MAX_BUCKETS of `gram` bytes. Tables are deleted from the shared folder after their last reader.

Defined results: a null text is empty (0 bytes, nothing removed); texts shorter than a window keep all bytes;
copies of a whole text lose all of it; repeated rows count as copies; extra columns stay out; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

LENGTH, GRAM = 200, 32
#: Bytes of entries that a bucket and a local sort aim at.
BUCKET_BYTES, SORT_BYTES = 8 << 20, 2 << 20
#: Tokens with more entries than this are cut into parts of PART windows, then into single ones.
HOT, PART = 20_000, 16
#: Tokens sampled for each bucket; classes that a task holds before it passes them on; most buckets.
SAMPLE, HELD, MAX_BUCKETS = 64, 100_000, 20_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _INVERSE):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _size(n: int) -> int:
    return 1 << max(16, int(n - 1).bit_length())


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base^position modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_size(len(data)))[0][: len(data)], out=out[1:])
    return out


def entries(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash (int64), first window, anchor's place in it, number of windows."""
    windows = len(data) - length + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 4
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    inverse = _powers(_size(len(data)))[1]
    w = length - gram + 1
    rows, bits = -(-n // w), np.uint64(w.bit_length())
    x = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    # the low bits are the place in the block, so the least value names the leftmost of equal hashes
    x[:n] = common.mix64((sums[gram:] - sums[:-gram]) * inverse[:n]) >> bits << bits
    x = x.reshape(rows, w) | np.arange(w, dtype=np.uint64)
    left = np.minimum.accumulate(x, axis=1).ravel()[w - 1 : w - 1 + windows]
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    least = np.where(right >> bits <= left >> bits, right, left)
    block = np.arange(windows) // w
    block += (right >> bits > left >> bits) & (np.arange(windows) % w > 0)
    anchor = block * w + (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return (least[first] >> bits).view(np.int64), first, anchor[first] - first, np.diff(np.r_[first, windows])


def _bytes(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value or b"", np.uint8)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def multikey_quicksort(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and the common prefix of each with the one before it (0 for the first).

    Three-way partition by characters of 8 bytes; all open segments take a step at a time. Equal characters go on at
    the next one, smaller and greater ones at the same; segments of one string, or at the end, are closed."""
    n, width = strings.shape
    chars = np.zeros((n, -(-width // 8) * 8), np.uint8)
    chars[:, :width] = strings
    chars = chars.view(">u8").astype(np.uint64)
    order = np.arange(n)
    start, size, depth = (np.array([x], np.int64) for x in (0, n, 0))
    while True:
        opened = (size > 1) & (depth < chars.shape[1])
        if not opened.any():
            break
        start, size, depth = start[opened], size[opened], depth[opened]
        segment = np.repeat(np.arange(len(start)), size)
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(segment))
        c = chars[order[at], depth[segment]]
        ends = np.cumsum(size)
        three = np.stack([c[ends - size], c[ends - size // 2 - 1], c[ends - 1]])
        pivot = np.sort(three, axis=0)[1][segment]
        side = segment * 3 + np.where(c < pivot, 0, np.where(c == pivot, 1, 2))
        order[at] = order[at[np.argsort(side, kind="stable")]]
        sizes = np.bincount(side, minlength=3 * len(start)).reshape(-1, 3)
        start = (start[:, None] + np.cumsum(sizes, axis=1) - sizes).ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
        size = sizes.ravel()
    prefix = np.zeros(n, np.int64)
    if n > 1:
        differ = strings[order[1:]] != strings[order[:-1]]
        prefix[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, prefix


def tied(contexts: list[bytes], anchors: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each class (its windows' bytes side by side, distinct; the anchor's place; how often it occurs)
    which windows occur twice or more among all."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    n_windows = sizes - length + 1
    first = np.r_[0, np.cumsum(n_windows)]
    marked = np.repeat(counts > 1, n_windows)  # all windows of a class that occurs twice
    data = np.frombuffer(b"".join(contexts), np.uint8)
    home = np.cumsum(sizes) - sizes + anchors
    deepest = max(1, int(anchors.max()))

    def sides(width: int, held: np.ndarray, step: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        j = np.arange(width)
        inside = j < held[:, None]
        return multikey_quicksort(np.where(inside, data[np.where(inside, home[:, None] + shift + step * j, 0)], 0).astype(np.uint8))

    right, common_right = sides(length, sizes - anchors, 1, 0)
    left, common_left = sides(deepest, anchors, -1, -1)
    # only a class whose suffix has a neighbour with enough in common can tie
    near = np.maximum(common_right, np.r_[common_right[1:], 0])
    some = np.zeros(len(sizes), bool)
    some[right] = near >= length - anchors[right]
    least, of_right, of_left = anchors - n_windows + 1, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if not some.any():
        return [marked[first[i] : first[i + 1]] for i in range(len(contexts))]
    for reach in range(int(least[some].min()), int(anchors[some].max()) + 1):
        live = np.flatnonzero(some & (least <= reach) & (anchors >= reach))
        if not len(live):
            continue
        of_right[right] = np.cumsum(common_right < length - reach)
        of_left[left] = np.cumsum(common_left < reach)
        _, back = np.unique(of_right[live] * len(sizes) + of_left[live], return_inverse=True)
        again = np.bincount(back, counts[live])[back] > 1
        marked[(first[live] + anchors[live] - reach)[again]] = True
    return [marked[first[i] : first[i + 1]] for i in range(len(contexts))]


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    step = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


MARKS = "marks array<struct<lo:long,hi:long>>"
_MARKS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Candidate texts (k0, k1, text: each distinct text that may lose bytes) and spans (k0, k1, marks: runs lo to hi,
    exclusive, of window starts whose windows occur twice or more)."""
    spark = docs.sparkSession
    rows = docs.where(F.octet_length(docs[text_col]) >= length).select(*text_key(docs[text_col]), docs[text_col].alias("text"))
    bits = (length - gram + 1).bit_length()
    low = (1 << bits) - 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            k0, k1 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k0", "k1"))
            names, packed, count = [], [], []
            for text in common.utf8_column(part.column("text")):
                name, first, anchor, n = entries(_bytes(text), length, gram)
                names.append(name)
                packed.append((first << bits | anchor) << bits | n - 1)
                count.append(len(name))
            yield pa.RecordBatch.from_pydict({"name": np.concatenate(names), "k0": np.repeat(k0, count), "k1": np.repeat(k1, count), "run": np.concatenate(packed)})

    found = rows.mapInArrow(sample, "name long, k0 long, k1 int, run long")
    # written, so that the join reads plain exchanges and a name with very many entries can be split
    twice = found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", (F.col("n") > HOT).alias("hot"))
    twice = common.staged(twice, "names")
    runs = found.join(twice, "name").groupBy("k0", "k1").agg(F.collect_set(F.struct("run", "hot")).alias("runs"))
    runs = runs.join(rows.groupBy("k0", "k1").agg(F.count("*").alias("copies")), ["k0", "k1"])
    runs = common.staged(runs, "runs")
    common.discard(twice)
    texts = rows.join(runs.drop("copies"), ["k0", "k1"], "left_semi")
    # copies of a text stand side by side after the exchange: keep the first of each
    texts = texts.groupBy("k0", "k1").agg(F.first("text").alias("text"))
    candidates = common.staged(texts.join(runs, ["k0", "k1"]), "candidates")

    n_entries, size = runs.agg(F.sum(F.size("runs")), F.sum(F.size("runs") * (length + 90))).first()
    some_hot = not runs.where(F.exists("runs", lambda x: x["hot"])).isEmpty()
    common.discard(runs)
    n_buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size or 0) // BUCKET_BYTES)))

    def entries_of(part: pa.RecordBatch) -> Iterator[tuple]:
        for i, (text, run) in enumerate(zip(common.utf8_column(part.column("text")), part.column("runs").to_pylist(), strict=True)):
            for x in run:
                first, anchor, n = x["run"] >> 2 * bits, x["run"] >> bits & low, (x["run"] & low) + 1
                yield i, x["hot"], first, anchor, text[first : first + n - 1 + length]

    splitters = _splitters(candidates, entries_of, n_entries or 0, n_buckets, gram)

    def batch_of(held: dict[tuple[int, bytes], int]) -> pa.RecordBatch:
        digests = [_digest(k[1]) for k in held]
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([bisect_right(splitters, c[a : a + gram]) for a, c in held], pa.int32()), "a": pa.array([k[0] for k in held], pa.int32()),
            "c0": pa.array([d[0] for d in digests], pa.int64()), "c1": pa.array([d[1] for d in digests], pa.int64()),
            "n": pa.array(list(held.values()), pa.int64()), "context": pa.array([k[1] for k in held], pa.binary()),
        })

    def classes(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[pa.RecordBatch]:
        """Entries as classes: equal ones of a task are added up before they are exchanged."""
        held: dict[tuple[int, bytes], int] = {}
        for part in _chunks(batches, 200):
            copies = part.column("copies").to_pylist()
            for i, is_hot, _, anchor, context in entries_of(part):
                if is_hot == hot:
                    key = (anchor, context)
                    held[key] = held.get(key, 0) + copies[i]
            if len(held) > HELD:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 200):
            k0, k1 = (part.column(c).to_pylist() for c in ("k0", "k1"))
            out = [(*_digest(context), k0[i], k1[i], first) for i, _, first, _, context in entries_of(part)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["c0", "c1", "k0", "k1", "first"])

    kinds = "bucket int, a int, c0 long, c1 long, n long, context binary"
    dealt = candidates.mapInArrow(lambda b: classes(b, False), kinds).repartitionById(n_buckets, "bucket")
    marks = _sorted_marks(dealt.withColumn("token", F.expr(f"substring(context, a + 1, {gram})")), ["c0", "c1"], length)
    if some_hot:
        marks = marks.union(_hot_marks(candidates.mapInArrow(lambda b: classes(b, True), kinds).drop("bucket"), n_buckets, length))
    # written, so that its size is known and the join on contexts that very many texts hold can be split
    marks = common.staged(marks, "marks")
    there = candidates.mapInArrow(members, "c0 long, c1 long, k0 long, k1 int, first long").join(marks, ["c0", "c1"])
    spans = there.groupBy("k0", "k1").agg(F.flatten(F.collect_list(_moved("first"))).alias("marks"))
    return candidates, spans


def _moved(by: str) -> Column:
    return F.transform("marks", lambda m: F.struct((m["lo"] + F.col(by)).alias("lo"), (m["hi"] + F.col(by)).alias("hi")))


def _splitters(candidates: DataFrame, entries_of: Callable, n_entries: int, n_buckets: int, gram: int) -> list[bytes]:
    """Bounds of the buckets: quantiles of the anchors' bytes, from about SAMPLE entries a bucket."""
    fraction = min(1.0, SAMPLE * n_buckets / max(n_entries, 1))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 200):
            yield pa.RecordBatch.from_pydict({"token": pa.array([c[a : a + gram] for _, hot, _, a, c in entries_of(part) if not hot], pa.binary())})

    found = sorted(bytes(r["token"]) for r in candidates.select("text", "runs").sample(fraction=fraction, seed=1).mapInArrow(tokens, "token binary").collect())
    return sorted({found[len(found) * i // n_buckets] for i in range(1, n_buckets)}) if found else []


def _digest(value: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(value)
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _sorted_marks(dealt: DataFrame, keys: list[str], length: int) -> DataFrame:
    """dealt: token, keys, a, n, context, with all classes of a token in one partition. The keys and the runs of tied windows.

    A partition is read token by token; what is held is SORT_BYTES, or one token."""
    kinds = [(k, dealt.schema[k].dataType.simpleString()) for k in keys]

    def marked(table: pa.Table) -> pa.RecordBatch:
        # the same class from several tasks becomes one
        table = table.group_by([*keys, "a", "context"]).aggregate([("n", "sum")])
        masks = tied(table["context"].to_pylist(), table["a"].to_numpy().astype(np.int64), table["n_sum"].to_numpy(), length)
        runs = [[{"lo": int(lo), "hi": int(hi)} for lo, hi in zip(*_spans(mask), strict=True)] for mask in masks]
        some = pa.array([i for i, r in enumerate(runs) if r], pa.int64())
        return pa.RecordBatch.from_pydict({k: table[k].combine_chunks().take(some) for k in keys} | {"marks": pa.array(runs, _MARKS).take(some)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if size >= SORT_BYTES:
                # what stands before the batch's last change of token is whole
                same = pa.compute.equal(part["token"], held[-1]["token"][-1]).to_numpy()
                cut = int(np.argmin(same)) if not same.all() else len(same)
                held.append(part.slice(0, cut))
                part = part.slice(cut)
                if part.num_rows:
                    yield marked(pa.concat_tables(held))
                    held, size = [], 0
            if part.num_rows:
                held.append(part)
                size += part.nbytes
        if held:
            yield marked(pa.concat_tables(held))

    return dealt.sortWithinPartitions("token").mapInArrow(run, ", ".join(f"{k} {kind}" for k, kind in kinds) + f", {MARKS}")


def parts_of(a: int, context: bytes, width: int, length: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """The windows around an anchor, cut where they reach a multiple of `width` bytes left of it: first window, anchor's
    place, token (the bytes that all windows of such a part have in common) and context of each part."""
    n = len(context) - length + 1
    for j in range((a - n + 1) // width, a // width + 1):
        first, last = max(0, a - j * width - width + 1), min(n - 1, a - j * width)
        at = a - j * width
        yield first, a - first, j.to_bytes(4, "big") + context[at : at + length - width + 1], context[first : last + length]


def _hot_marks(classes: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """The same for tokens with very many entries, by longer tokens: parts of PART windows, then single windows."""
    classes = common.staged(classes.groupBy("c0", "c1", "a").agg(F.sum("n").alias("n"), F.first("context").alias("context")), "hot-classes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 200):
            c0, c1, a, n, contexts = (part.column(c).to_pylist() for c in ("c0", "c1", "a", "n", "context"))
            out = [(c0[i], c1[i], first, xxhash.xxh3_64_intdigest(token) - (1 << 63), *_digest(bytes_), at, n[i], bytes_) for i in range(len(n)) for first, at, token, bytes_ in parts_of(a[i], contexts[i], PART, length)]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kind) for k, v, kind in zip(("c0", "c1", "delta", "token", "s0", "s1", "a", "n", "context"), zip(*out, strict=True), (*[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary()), strict=True)})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 200):
            s0, s1, n, contexts = (part.column(c).to_pylist() for c in ("s0", "s1", "n", "context"))
            out = [(s0[i], s1[i], j, n[i], context[j : j + length]) for i, context in enumerate(contexts) for j in range(len(context) - length + 1)]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kind) for k, v, kind in zip(("s0", "s1", "j", "n", "window"), zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)})

    parts = common.staged(classes.mapInArrow(cut, "c0 long, c1 long, delta long, token long, s0 long, s1 long, a int, n long, context binary"), "hot-parts")
    sub = common.staged(parts.groupBy("s0", "s1", "a", "token").agg(F.sum("n").alias("n"), F.first("context").alias("context")), "hot-part-classes")
    many = common.staged(sub.groupBy("token").count().where(F.col("count") > HOT).select("token"), "hot-tokens")
    few = sub.join(many, "token", "left_anti").repartition(n_buckets, "token")
    marks = _sorted_marks(few, ["s0", "s1"], length)
    if not many.isEmpty():
        single = common.staged(sub.join(many, "token", "left_semi").mapInArrow(windows, "s0 long, s1 long, j long, n long, window binary"), "hot-windows")
        twice = common.staged(single.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"), "hot-twice")
        again = single.join(twice, "window").groupBy("s0", "s1").agg(F.collect_set(F.struct(F.col("j").alias("lo"), (F.col("j") + 1).alias("hi"))).alias("marks"))
        marks = marks.union(again)
    marks = common.staged(marks, "hot-marks")
    there = parts.select("c0", "c1", "delta", "s0", "s1").join(marks, ["s0", "s1"])
    return there.groupBy("c0", "c1").agg(F.flatten(F.collect_list(_moved("delta"))).alias("marks"))


def text_key(text) -> list:
    """A 96-bit key of a text."""
    return [F.xxhash64(text).alias("k0"), F.hash(F.lit(7), text).alias("k1")]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of removed first and last byte, exclusive)."""
    candidates, runs = repeated_spans(docs, text_col, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 200):
            removed, number, sha, spans = [], [], [], []
            for text, marks in zip(common.utf8_column(part.column("text")), part.column("marks").to_pylist(), strict=True):
                step = np.zeros(len(text) + 1, np.int64)
                lo, hi = np.array([m["lo"] for m in marks]), np.array([m["hi"] for m in marks])
                np.add.at(step, lo, 1)
                np.add.at(step, hi - 1 + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                s, e = _spans(gone)
                removed.append(int(gone.sum()))
                number.append(len(s))
                sha.append(hashlib.sha256(_bytes(text)[~gone].tobytes()).hexdigest())
                spans.append([{"first": int(a), "last": int(b)} for a, b in zip(s, e, strict=True)])
            yield pa.RecordBatch.from_pydict({"k0": part.column("k0"), "k1": part.column("k1"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(number, pa.int64()), "sha": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))})

    changed = candidates.select("k0", "k1", "text").join(runs, ["k0", "k1"]).mapInArrow(cut, "k0 long, k1 int, n_removed long, n_spans long, sha string, spans array<struct<first:long,last:long>>")
    text = F.coalesce(docs[text_col], F.lit(""))
    every = docs.select(docs[id_col].alias("doc_id"), *text_key(docs[text_col]), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    out = every.join(changed, ["k0", "k1"], "left")
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("spans", none).alias("spans"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op8_suffix_array": op8_suffix_array}
ORACLES: dict[str, str] = {}
