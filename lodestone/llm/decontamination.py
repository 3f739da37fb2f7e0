"""Benchmark decontamination: spaced-seed hashing.

Words (lower-cased, ASCII punctuation as space) of test items and of documents are hashed under fixed masks
that ignore some positions, so a few substituted words do not hide a copied passage. Document hashes are
joined with the test hashes (a bit table first, then binary search); around every hit the document
is laid along the item, and of all its stretches in which at least MIN_IDENTITY of the words are equal that with the most equal
words is verified: MIN_MATCHED of them are needed (all words of a shorter item). A whole copy is also
one where the equal words of the untrimmed overlap reach MIN_IDENTITY of the item, and MIN_WORDS.

Spaced seeds may miss a whole copy, so items are also hashed in runs of the length that stays intact
however the allowed substitutions are placed: 3 words, or 2 for items of 5 and 8. These hits are
counted in arrays and need the whole-copy rule.

Test items are the small side: the join is one of hashes in memory. Items are dealt into blocks of at most BLOCK_BYTES of text,
whose hashes (about 27 times that, in arrays) are sent to all tasks, and each block is matched in a pass of its own over
all documents: what a task holds is bounded however many items there are, and passes grow with the items. An exchange of
documents' hashes instead would move 40 bytes a word, over ten times the texts. Documents are never shuffled and each
is judged whole, in one task; hits are counted in arrays, and only those with enough equal words are looked at one by one.

Defined results: null or empty texts and items match nothing; items with fewer than MIN_WORDS words cannot be
told from chance and match nothing; items shorter than a mask match where all their words
stand in a row; repeated rows are judged one by one; extra columns pass through `remove_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

#: Fixed masks: 1 is compared, 0 ignored.
MASKS = ("111111", "11101011", "11100111", "101101101", "1101001011")
MIN_MATCHED, MIN_IDENTITY, MIN_WORDS = 12, 0.75, 4
BLOCK_BYTES = 8 << 20
_SPACES = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
_COMBINE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and each text's number of words."""
    split = [t.lower().encode("utf-8", "replace").translate(_SPACES).split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    code, words = pd.factorize(np.array([w for ws in split for w in ws] + [None], object)[:-1])
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return (own[code] if len(words) else np.zeros(0, np.uint64)), sizes


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash under the mask from each position where the mask fits."""
    n = len(hashes) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, sum(1 << i for i, x in enumerate(mask) if x == "1"), np.uint64)
    for i, x in enumerate(mask):
        if x == "1":
            out = out * _COMBINE + hashes[i : i + n]
    return common.mix64(out)


def longest_stretch(same: np.ndarray) -> tuple[int, int]:
    """The stretch with the most equal words of all in which at least MIN_IDENTITY of the words are equal (of equal ones that which
    ends first), cut to begin and end with an equal word.

    For each end, the first start whose prefix sum of (1 - MIN_IDENTITY for an equal word, -MIN_IDENTITY for another) is not above the
    end's; running minima of the sums fall, so it is found by binary search."""
    cost = np.r_[0, np.cumsum(np.where(same, 100 - int(100 * MIN_IDENTITY), -int(100 * MIN_IDENTITY)))]
    start = np.searchsorted(-np.minimum.accumulate(cost), -cost, side="left")
    equal = np.r_[0, np.cumsum(same)]
    end = int(np.argmax(equal - equal[start]))
    if not end:
        return 0, 0
    inside = np.flatnonzero(same[start[end] : end])
    return int(start[end] + inside[0]), int(start[end] + inside[-1] + 1)


class Seeds:
    """The masked hashes of a block of test items."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS):
        self.ids = [i for i, _ in items]
        flat, sizes = word_hashes([t for _, t in items])
        ends = np.cumsum(sizes)
        self.words = [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        short = {int(n) for n in sizes if MIN_WORDS <= n < max(map(len, masks))}
        self.masks = (*masks, *("1" * n for n in sorted(short) if "1" * n not in masks))
        self.flat, self.sizes, self.starts = flat, sizes, ends - sizes
        self.least = np.maximum(np.ceil(MIN_IDENTITY * sizes).astype(np.int64), MIN_WORDS)
        changed = np.maximum(sizes - self.least, 0)
        intact = -(-(sizes - changed) // (changed + 1))
        self.runs = tuple("1" * n for n in sorted({int(n) for n in intact[changed > 0]}))
        self.n_seeds, self.masks = len(self.masks), (*self.masks, *self.runs)
        hashes, item, offset, which = [], [], [], []
        for i, w in enumerate(self.words):
            if len(w) < MIN_WORDS:
                continue
            for m, mask in enumerate(self.masks):
                if m >= self.n_seeds:
                    if not changed[i] or len(mask) != intact[i]:
                        continue
                elif m >= len(masks) and len(mask) != len(w):
                    continue
                h = masked(w, mask)
                hashes.append(h)
                item.append(np.full(len(h), i))
                offset.append(np.arange(len(h)))
                which.append(np.full(len(h), m))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item, self.offset, self.which = ((np.concatenate(x) if x else np.zeros(0, np.int64))[order] for x in (item, offset, which))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hash >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Item and diagonal (document position minus item position) of each hit of the seeds or of the runs, distinct."""
        found = []
        for m, mask in enumerate(self.masks):
            if (m >= self.n_seeds) != runs:
                continue
            h = masked(words, mask)
            at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            n = hi - lo
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ok = self.which[entry] == m
            entry, position = entry[ok], np.repeat(at, n)[ok]
            found.append((self.item[entry] << 32) + (position - self.offset[entry]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(found))
        item = (both + (1 << 31)) >> 32
        return item, both - (item << 32)

    def equal_words(self, words: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """How many of the item's words the document has along each diagonal."""
        out = np.zeros(len(item), np.int64)
        for lo, hi in common.blocks(self.sizes[item], common.BLOCK_WORDS):
            n = self.sizes[item[lo:hi]]
            of = np.repeat(np.arange(hi - lo), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = place + diagonal[lo:hi][of]
            inside = (at >= 0) & (at < len(words))
            same = inside & (words[np.where(inside, at, 0)] == self.flat[self.starts[item[lo:hi]][of] + place])
            out[lo:hi] = np.bincount(of, same, hi - lo)
        return out

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """Best verified overlap with each item: item id, equal words, overlap's words, first word in the
        document, first word in the item, item's words."""
        best: dict[int, tuple] = {}
        item, diagonal = self.hits(words, runs=True)
        copies = self.equal_words(words, item, diagonal) >= self.least[item]
        seeded = self.hits(words)
        # only hits with enough equal words along the whole item can pass; items with one opening give many that cannot
        enough = self.equal_words(words, *seeded) >= np.minimum(np.minimum(MIN_MATCHED, self.sizes), self.least)[seeded[0]]
        both = [np.concatenate(x) for x in zip((seeded[0][enough], seeded[1][enough]), (item[copies], diagonal[copies]), strict=True)]
        for i, d in sorted(set(zip(*(x.tolist() for x in both), strict=True))):
            own = self.words[i]
            lo, hi = max(0, -d), min(len(own), len(words) - d)
            same = own[lo:hi] == words[lo + d : hi + d]
            start, end = longest_stretch(same)
            matched = int(same[start:end].sum())
            if matched >= min(MIN_MATCHED, len(own)):
                if i not in best or matched > best[i][1]:
                    best[i] = (self.ids[i], matched, end - start, start + lo + d, start + lo, len(own))
            elif int(same.sum()) >= self.least[i] and (i not in best or int(same.sum()) > best[i][1]):
                best[i] = (self.ids[i], int(same.sum()), hi - lo, lo + d, lo, len(own))
        return [best[i] for i in sorted(best)]


def _per_text(texts: list[str | None]) -> Iterator[np.ndarray]:
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    for lo, hi in common.blocks(sizes, 6 * common.BLOCK_WORDS):
        flat, n = word_hashes(texts[lo:hi])
        for e, m in zip(np.cumsum(n).tolist(), n.tolist(), strict=True):
            yield flat[e - m : e]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[Seeds]:
    """The test items, one block after the other; each is bounded in bytes."""
    rows = items.select(items[id_col].alias("i"), items[text_col].alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else rows
        yield Seeds([(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_matched, n_overlap, doc_start, item_start, item_words."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ("item_id", "n_matched", "n_overlap", "doc_start", "item_start", "item_words")

    def passed(seeds: Seeds) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found = [], []
                for i, words in enumerate(_per_text(batch.column("text").to_pylist())):
                    for x in held.value.overlaps(words):
                        at.append(i)
                        found.append(x)
                columns = zip(*found, strict=True) if found else [[]] * len(names)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64()))} | {n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

        return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))

    out = None
    for seeds in item_blocks(items, block_bytes=block_bytes):
        out = passed(seeds) if out is None else out.union(passed(seeds))
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns."""
    at = docs.columns.index(text_col)
    for seeds in item_blocks(items, block_bytes=block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not held.value.overlaps(words) for words in _per_text(batch.column(at).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_spaced_seeds": op4_spaced_seeds}
ORACLES: dict[str, str] = {}
