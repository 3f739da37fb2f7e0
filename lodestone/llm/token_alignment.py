"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, by id-striped dense count matrices.

A text is encoded by a byte-level BPE (A) and by a sentence-piece BPE with byte fallback (B). Byte offsets where tokens of both
end cut it into groups; every A token of a group is linked with every B token of it. The count of an id pair is the number
of documents that hold it linked, and a link is best if no other B id has a higher count with its A id.

1. Encode. Texts are read once, in blocks. A block is one row: its documents, and for each stripe of A ids
   (id modulo STRIPES) the distinct id pairs with the documents that hold them. The table is written.
2. Count. Each task adds up the pairs of its blocks, so many pairs at a time; a stripe's sums meet in one task, which
   adds them (np.add.at) into a dense matrix of the stripe's A ids by all B ids. Row maxima are the best counts. A stripe gets at most
   one row of sums for each time that a task is full, whatever an id's share of the corpus.
3. Score. A stripe's links go to as many tasks as they need (dealt by block), and its matrix goes to each of
   them, ahead of the links in the sort order. Links are looked up there, and sums by document go back to their block.

Memory is bounded by a dense stripe (8 bytes for each of its ids' pairs), the held pairs and a block; a text longer than a block is
a block of its own, whose links are made in chunks.

A's merges are run by tiktoken over the same vocabulary, which gives the ids of the vocabulary's own file (tested on all code points and texts).

Defined results: a null or empty text, or one that either tokenizer cannot give back byte by byte (such as text with U+2581), has no
tokens: zeros and an empty digest; strings of special tokens are plain text; repeated rows are documents of their own;
extra columns stay out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how vocabulary A splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Sizes:
    """How finely the work is cut; no result depends on it."""

    #: stripes of A ids
    stripes: int = 128
    #: characters times 1.5, and documents (65,536 at most), of a block
    block_bytes: int = 2 << 20
    block_docs: int = 1 << 16
    #: links made at a time
    chunk: int = 1 << 21
    #: distinct pairs that a counting task holds; cells in a row of the count table; pairs of a document for each scoring task
    held: int = 1 << 22
    cells: int = 1 << 20
    links: int = 1 << 23


SIZES = Sizes()


class Vocabulary:
    """Both tokenizers, and the byte length of every id."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{FILE_A}", encoding="utf-8") as f:
            stored = json.load(f)
        special = {x["id"] for x in stored["added_tokens"]}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in token): i for token, i in stored["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
        self.size_a, self.size_b = max(ranks.values()) + 1, self.b.vocab_size()
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.size_b)))]
        self.length_a, self.length_b = np.zeros(self.size_a, np.int64), np.array([len(x) for x in self.bytes_b])
        for token, i in ranks.items():
            self.length_a[i] = len(token)
        n = max(self.size_a, self.size_b)
        #: decimal ids with the separator that follows, padded with zero bytes
        self.written = np.array([f"{i}{end}" for end in ",|;" for i in range(n)], "S")
        self.n_written = n

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A and B ids of each text; None where there are none."""
        out = []
        for text, b in zip(texts, self.b.encode([x or "" for x in texts], num_threads=1), strict=True):
            whole = b" " + text.encode() if text else b""
            if not whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                out.append(None)
                continue
            a = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
            out.append((a, np.array(b, np.int64)) if self.a.decode_bytes(a) == whole else None)
        return out


@lru_cache(maxsize=2)
def vocabulary(folder: str) -> Vocabulary:
    return Vocabulary(folder)


def aligned(v: Vocabulary, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
    """The groups of several encoded texts at once: ids, group of each token, tokens of each group by side, group bounds of the texts.

    Ends are marked on the bytes of all texts in a row, so a text's last end, which both sides have, also ends a group."""
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *(p[side] for p in pairs)]) for side in (0, 1))
    end_a, end_b = np.cumsum(v.length_a[a]), np.cumsum(v.length_b[b])
    mark = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, np.uint8)
    mark[end_a] = 1
    mark[end_b] += 1
    last_a, last_b = mark[end_a] == 2, mark[end_b] == 2
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n = int(last_a.sum())
    bounds = np.concatenate([[0], np.cumsum(last_a)[np.cumsum([len(p[0]) for p in pairs]) - 1]]) if pairs else np.zeros(1, np.int64)
    return a, b, group_a, group_b, np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n), bounds, last_a, last_b


def group_texts(v: Vocabulary, groups: tuple, pairs: list) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` for each text."""
    a, b, group_a, group_b, in_a, in_b, _, last_a, last_b = groups
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + v.n_written * last_a
    order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = b + 2 * v.n_written * last_b
    sizes = np.array([len(x) + len(y) for x, y in pairs], np.int64)
    return [v.written[order[hi - n : hi]].tobytes().translate(None, b"\0")[:-1] for n, hi in zip(sizes, np.cumsum(sizes), strict=True)]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def links(v: Vocabulary, groups: tuple, doc_of_group: np.ndarray, stripes: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (stripe, A id in the stripe, B id, text) packed into 63 bits, in order, and the number of links of each."""
    a, b, _, _, in_a, in_b, _, _, _ = groups
    width = np.int64(len(v.length_a) // stripes + 1) * v.size_b
    pair = lambda x, y, doc: (((x % stripes) * width + x // stripes * v.size_b + y) << np.int64(16)) | doc
    size, first_a, first_b = in_a * in_b, np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in common.blocks(size, chunk):
        if hi - lo == 1 and size[lo] > chunk:  # one huge group: its distinct ids, some rows of their product at a time
            (ids, times), (ids_b, times_b) = (np.unique(x[s : s + k], return_counts=True) for x, s, k in ((a, first_a[lo], in_a[lo]), (b, first_b[lo], in_b[lo])))
            step = max(1, chunk // len(ids_b))
            for i in range(0, len(ids), step):
                some = ids[i : i + step]
                found.append((pair(np.repeat(some, len(ids_b)), np.tile(ids_b, len(some)), doc_of_group[lo]), np.outer(times[i : i + step], times_b).ravel()))
            continue
        n_a, n_b = in_a[lo:hi], in_b[lo:hi]
        times = np.repeat(n_b, n_a)  # links of each A token
        of = np.repeat(np.arange(hi - lo), n_a)
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b[lo:hi][of], times)
        x = np.repeat(a[first_a[lo] : first_a[hi - 1] + in_a[hi - 1]], times)
        key = np.sort(pair(x, b[at], np.repeat(doc_of_group[lo:hi][of], times)))
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        found.append((key[start], np.diff(np.r_[start, len(key)])))
    if len(found) == 2:
        return found[1]
    return _summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def _small(x: np.ndarray) -> bytes:
    """As the narrowest unsigned integers that hold it; one byte ahead names their size."""
    kind = next(k for k in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * k))
    return bytes([kind]) + x.astype(f"<u{kind}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"


def _blocks(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts of one block after the other."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in common.blocks(np.array([len(x or "") * 3 // 2 + -(-sizes.block_bytes // sizes.block_docs) for x in texts], np.int64), sizes.block_bytes):
            yield batch.column("doc_id").slice(lo, hi - lo), texts[lo:hi]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, sizes: Sizes = SIZES, with_groups: bool = False) -> DataFrame:
    """One row per block: block, docs (one struct a document: doc_id, counts, digest and, if asked, text of its groups) and links
    (one struct a stripe: codes of the distinct pairs, documents of each, which these are, and links in each)."""
    stripes = sizes.stripes
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    doc = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {DOC}"
    schema = f"block long, docs array<struct<{doc}>>, links array<struct<stripe int, codes binary, reps binary, docs binary, times binary>>"

    def run(batches):
        v = vocabulary(folder)
        width = np.int64(len(v.length_a) // stripes + 1) * v.size_b
        partition = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_blocks(batches, sizes)):
            found = v.encode(texts)
            known = [i for i, x in enumerate(found) if x]
            pairs = [found[i] for i in known]
            groups = aligned(v, pairs)
            in_a, in_b, bounds = groups[4:7]
            n = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
            sha, told = [""] * len(texts), [None] * len(texts)
            made = np.r_[0, np.cumsum(in_a * in_b)]
            for j, (i, text) in enumerate(zip(known, group_texts(v, groups, pairs), strict=True)):
                n["n_a"][i], n["n_b"][i], n["n_groups"][i] = len(pairs[j][0]), len(pairs[j][1]), bounds[j + 1] - bounds[j]
                n["n_links"][i] = made[bounds[j + 1]] - made[bounds[j]]
                sha[i] = hashlib.sha256(text).hexdigest()
                told[i] = text.decode() if with_groups else None
            key, times = links(v, groups, np.repeat(np.array(known, np.int64), np.diff(bounds)), stripes, sizes.chunk)
            pair, of = key >> np.int64(16), key & np.int64(0xFFFF)
            stripe = pair // width
            cuts = np.flatnonzero(np.r_[True, stripe[1:] != stripe[:-1], True]) if len(key) else np.zeros(0, np.int64)
            cells = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                code = pair[lo:hi] % width
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                cells.append({"stripe": int(stripe[lo]), "codes": _small(code[first]), "reps": _small(np.diff(np.r_[first, hi - lo])), "docs": _small(of[lo:hi]), "times": _small(times[lo:hi])})
            cell = pa.struct([("stripe", pa.int32()), *((k, pa.binary()) for k in ("codes", "reps", "docs", "times"))])
            struct = pa.StructArray.from_arrays([ids, *(pa.array(x) for x in n.values()), pa.array(sha, pa.string()), pa.array(told, pa.string())], ["doc_id", *n, "groups_sha256", "groups"])
            yield pa.RecordBatch.from_arrays([pa.array([partition << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), struct), pa.array([cells], pa.list_(cell))], ["block", "docs", "links"])

    return rows.mapInArrow(run, schema)


def count_matrix(blocks: DataFrame, folder: str = TOKENIZERS, sizes: Sizes = SIZES) -> DataFrame:
    """The cells of the count matrices that are not zero: stripe, codes (A id // stripes * size of B + B id), counts,
    best (1 where the count is its A id's highest) and pairs (pairs of a document behind the row)."""
    stripes = sizes.stripes

    def combine(batches):
        """Sums of the pairs of a task's blocks."""
        held: dict[int, list] = {}
        size = 0

        def out():
            for stripe, parts in held.items():
                code, n = _summed(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
                yield pa.RecordBatch.from_pydict({"stripe": pa.array([stripe], pa.int32()), "codes": [_small(code)], "counts": [_small(n)]})

        for batch in batches:
            for stripe, codes, reps in zip(*(batch.column(c).to_pylist() for c in ("stripe", "codes", "reps")), strict=True):
                code = _large(codes)
                held.setdefault(stripe, []).append((code, _large(reps)))
                size += len(code)
                if size > sizes.held:
                    held = {k: [_summed(np.concatenate([c for c, _ in p]), np.concatenate([n for _, n in p]))] for k, p in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if 2 * size > sizes.held:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    def fill(batches):
        """A stripe's dense matrix, from rows in the order of stripes."""
        v = vocabulary(folder)
        dense, at = None, None

        def out():
            code = np.flatnonzero(dense.ravel())
            rows = np.unique(code // v.size_b)
            highest = np.zeros(len(dense), np.int64)
            for some in np.array_split(rows, -(-len(rows) // 64)):
                highest[some] = dense[some].max(axis=1)
            n = dense.ravel()[code]
            for lo in range(0, len(code), sizes.cells):
                c, k = code[lo : lo + sizes.cells], n[lo : lo + sizes.cells]
                best = (k == highest[c // v.size_b]).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"stripe": pa.array([at], pa.int32()), "codes": [_small(c)], "counts": [_small(k)], "best": [best.tobytes()], "pairs": pa.array([int(k.sum())], pa.int64())})

        for batch in batches:
            for stripe, codes, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "codes", "counts")), strict=True):
                if stripe != at:
                    if at is not None:
                        yield from out()
                    dense, at = np.zeros((v.size_a // stripes + 1, v.size_b), np.int64), stripe
                np.add.at(dense.ravel(), _large(codes), _large(counts))
        if at is not None:
            yield from out()

    sums = blocks.select(F.explode("links").alias("l")).select("l.stripe", "l.codes", "l.reps").mapInArrow(combine, "stripe int, codes binary, counts binary")
    return sums.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(fill, "stripe int, codes binary, counts binary, best binary, pairs long")


def pair_counts(matrix: DataFrame, folder: str = TOKENIZERS, sizes: Sizes = SIZES) -> DataFrame:
    """The id pairs of `count_matrix` as rows: a, b, count, best."""
    stripes = sizes.stripes

    def run(batches):
        n = vocabulary(folder).size_b
        for batch in batches:
            for stripe, codes, counts, best in zip(*(batch.column(c).to_pylist() for c in ("stripe", "codes", "counts", "best")), strict=True):
                code = _large(codes)
                yield pa.RecordBatch.from_pydict({"a": code // n * stripes + stripe, "b": code % n, "count": _large(counts), "best": np.frombuffer(best, np.uint8) == 1})

    return matrix.select("stripe", "codes", "counts", "best").mapInArrow(run, "a long, b long, count long, best boolean")


def scored(blocks: DataFrame, matrix: DataFrame, folder: str = TOKENIZERS, sizes: Sizes = SIZES) -> DataFrame:
    """One row per document: doc_id, DOC, n_best, count_sum. Both tables are written ones.

    One number of tasks for each stripe is held by the driver."""
    stripes = sizes.stripes
    spark = blocks.sparkSession
    load = {r["stripe"]: r["pairs"] for r in matrix.groupBy("stripe").agg(F.sum("pairs").alias("pairs")).collect()}
    shares = F.array(*(F.lit(int(load.get(i, 0) // sizes.links + 1)) for i in range(stripes)))
    share = F.get(shares, F.col("stripe"))
    empty = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    tables = matrix.select("stripe", F.explode(F.sequence(F.lit(0), share - 1)).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "codes", "counts", "best", *empty("reps", "docs", "times"))
    each = blocks.select("block", F.explode("links").alias("l")).select("block", "l.*")
    each = each.select("stripe", F.pmod(F.xxhash64("block"), share).cast("int").alias("share"), F.lit(1).alias("kind"), "block", "codes", *empty("counts", "best"), "reps", "docs", "times")

    def score(batches):
        v = vocabulary(folder)
        at, counts, best = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["stripe"], r["share"]) != at:
                    at = (r["stripe"], r["share"])
                    counts, best = np.zeros((v.size_a // stripes + 1) * v.size_b, np.int64), np.zeros((v.size_a // stripes + 1) * v.size_b, np.uint8)
                code = _large(r["codes"])
                if not r["kind"]:
                    counts[code], best[code] = _large(r["counts"]), np.frombuffer(r["best"], np.uint8)
                    continue
                reps, doc, times = _large(r["reps"]), _large(r["docs"]), _large(r["times"])
                n_best, total = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(n_best, doc, np.repeat(best[code], reps) * times)
                np.add.at(total, doc, np.repeat(counts[code], reps) * times)
                held = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int64()), "held": [_small(held)], "n_best": [_small(n_best[held])], "total": [_small(total[held])]})

    both = tables.unionByName(each).repartition("stripe", "share").sortWithinPartitions("stripe", "share", "kind")
    parts = both.mapInArrow(score, "block long, held binary, n_best binary, total binary")
    own = blocks.select("block", F.lit(0).alias("kind"), "docs", *empty("held", "n_best", "total"))
    parts = parts.select("block", F.lit(1).alias("kind"), F.lit(None).cast(blocks.schema["docs"].dataType).alias("docs"), "held", "n_best", "total")
    names = [f.split()[0] for f in DOC.split(", ")]

    def add(batches):
        docs, n_best, total = None, None, None

        def out():
            yield pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(n_best), pa.array(total)], ["doc_id", *names, "n_best", "count_sum"])

        for batch in batches:
            kinds, own_docs = batch.column("kind").to_pylist(), batch.column("docs")
            rest = [batch.column(c).to_pylist() for c in ("held", "n_best", "total")]
            for i, kind in enumerate(kinds):
                if not kind:
                    if docs is not None:
                        yield from out()
                    docs = own_docs[i].values
                    n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                    continue
                held = _large(rest[0][i])
                n_best[held] += _large(rest[1][i])
                total[held] += _large(rest[2][i])
        if docs is not None:
            yield from out()

    kind = next(f.dataType for f in blocks.schema["docs"].dataType.elementType.fields if f.name == "doc_id").simpleString()
    return own.unionByName(parts).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(add, f"doc_id {kind}, {DOC}, n_best long, count_sum long")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, sizes: Sizes = SIZES, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (null unless asked for), n_best, count_sum."""
    blocks = common.staged(encoded(docs, id_col, text_col, folder, sizes, with_groups), "alignment")
    matrix = common.staged(count_matrix(blocks, folder, sizes), "alignment-counts")
    return scored(blocks, matrix, folder, sizes)


def op12_dense_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents")).drop("groups")


QUERIES = {"op12_dense_alignment": op12_dense_alignment}
#: Tokenizers have no SQL form; tests compare with brute force.
ORACLES: dict[str, str] = {}
