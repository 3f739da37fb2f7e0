"""MinHash near-dedup: b-bit MinHash.

1. One pass over the texts gives, per document, the digest of its shingle set, 128 minima of its
   shingles' 64-bit hashes, 32 band keys (4 minima each) and the low 2 bits of every minimum, packed
   into four 64-bit words.
2. Documents with equal sets form a class; from here on a class is one row, however many copies it has.
3. Classes that share a band are candidates. Each bucket ties its members to one of them, chosen
   by the bucket's own key, so a large group gets many different centres but only one pair a member and band.
   The packed words give the similarity, corrected for the 2-bit values that agree by chance, from a count of
   differing bits; pairs far below the threshold go.
4. The rest is confirmed on full sets, block by block, and confirmed links give components.
5. Buckets that then still hold several components are searched completely, but not by their bands: documents with
   common boilerplate share bands and are not alike. Their members' shingles are ordered by frequency, rarest first; two sets at or
   above the threshold share one of their first shingles (prefix filter: the larger set within its first
   n - ceil(t n) + 1, the smaller within its first n - ceil(2 t n / (1 + t)) + 1), which boilerplate never is. Members outside the
   main component of such a shingle are a query set against the others, in two-dimensional blocks (so many members, so
   many queries): first by packed words, then on full sets. So no candidate link between components is left out,
   and no pairs are emitted.

Bands of 4 of 128 minima miss a pair at similarity 0.8 with probability (1 - 0.8^4)^32 < 1e-7; the
estimate is cut 5 standard deviations below the threshold.

Scale: texts are shuffled once for the candidates of step 4 and once for those of step 5 if there are any; buckets are
aggregated with partial sums and joined with adaptive skew handling; a block holds BLOCK_IDS documents and as many queries, or
fewer where they are long (BLOCK_SHINGLES). Frequencies are sums in SLOTS counters by hash, so what is broadcast is 8 MB
however much text there is; two shingles in one counter only change the order.

Defined results: a null or empty text, or one without words, has 0 shingles and is linked with nothing; with
fewer words than a shingle the whole sequence is one. Repeated rows are one class. Null ids keep their rows.
`keep_one`, unlike the column kept, leaves one row of a group also
where ids are repeated or null. Extra columns stay out (or, in `keep_one`, stay with their rows). An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.components import components

MINIMA, BAND, BITS = 128, 4, 2
#: Standard deviations below the threshold at which the estimate drops a candidate.
SIGMAS = 5.0
#: Documents whose sets one task holds at a time when it confirms links.
BLOCK_IDS, BLOCK_SHINGLES = 400, 4_000_000
#: Counters of shingle frequencies.
SLOTS = 1 << 20
_RANDOM = np.random.default_rng(20240607)
FACTORS = (_RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_COMBINE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles, A-Z lower-cased."""
    split = [t.lower().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    out: list[np.ndarray] = []
    for lo, hi in common.blocks(sizes, common.BLOCK_WORDS):
        code, words = pd.factorize(np.array([w for ws in split[lo:hi] for w in ws] + [None], object)[:-1])
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[code] if len(words) else np.zeros(0, np.uint64)
        at = 0
        for n in sizes[lo:hi].tolist():
            h = hashes[at : at + n]
            at += n
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            width = min(k, n)
            s = np.full(n - width + 1, width, np.uint64)
            for j in range(width):
                s = common.mix64(s * _COMBINE + h[j : n - width + 1 + j])
            s.sort()
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions, as 32 bits."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[lo : lo + 2048, None] * FACTORS + OFFSETS).min(axis=0))
    return least >> np.uint64(32)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64), and the low bits of all minima packed into words (int64)."""
    low = minima(shingles)
    key = np.arange(MINIMA // BAND, dtype=np.uint64)
    for j in range(BAND):
        key = common.mix64(key * _COMBINE + low[j::BAND])
    per = 64 // BITS
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return key.view(np.int64), np.bitwise_or.reduce(bits, axis=1).view(np.int64)


WORDS = MINIMA * BITS // 64
PACKED = [f"w{i}" for i in range(WORDS)]


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity from the packed words of two sides (column prefixes a, b)."""
    odd = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for w in PACKED:
        x = F.col(a + w).bitwiseXOR(F.col(b + w))
        differ = differ + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(MINIMA))) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int, row_col: str | None = None) -> DataFrame:
    u = docs[row_col] if row_col else F.monotonically_increasing_id()
    rows = docs.select(u.alias("u"), docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("t"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = shingle_sets(common.utf8_column(part.column("text")), k)
                keys = np.zeros((len(sets), MINIMA // BAND), np.int64)
                packed = np.zeros((len(sets), WORDS), np.int64)
                digest = np.zeros((len(sets), 2), np.int64)
                for i, s in enumerate(sets):
                    if len(s):
                        keys[i], packed[i] = signature(s)
                        digest[i] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_pydict({"u": part.column("u"), "doc_id": part.column("doc_id"), "t": part.column("t"), "n": pa.array([len(s) for s in sets], pa.int64()), "d0": pa.array(digest[:, 0].copy()), "d1": pa.array(digest[:, 1].copy()), "bands": bands} | {w: pa.array(packed[:, i].copy()) for i, w in enumerate(PACKED)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"u long, doc_id {kind}, t long, n long, d0 long, d1 long, bands array<long>, " + ", ".join(f"{w} long" for w in PACKED))


def confirmed(pairs: DataFrame, where: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """pairs: a, b (class numbers), size (shingles of both). where: c, doc_id, t of each class. The pairs whose full sets reach the threshold.

    Pairs are dealt into blocks by a; a block gets each text that it needs once."""
    n, shingles = pairs.agg(F.approx_count_distinct("a"), F.sum("size")).first()
    n_blocks = max(1, -(-n // BLOCK_IDS), -(-(shingles or 0) // BLOCK_SHINGLES))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(n_blocks)).cast("int"))
    needs = dealt.select("block", F.col("a").alias("c")).union(dealt.select("block", F.col("b").alias("c"))).distinct()
    needs = needs.join(where, "c").select("block", "c", F.col("doc_id").alias("id_"), F.col("t").alias("t_"))
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("t"))
    texts = needs.join(texts, (F.col("t_") == F.col("t")) & F.col("id_").eqNullSafe(F.col("doc_id"))).select(F.col("block").alias("of_block"), "c", "text")
    pct, of = round(threshold * 10_000), 10_000

    def check(pair: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        text = text.drop_duplicates("c")
        sets = dict(zip(text["c"].tolist(), shingle_sets([x.encode() for x in text["text"]], k), strict=True))
        keep = []
        for a, group in pair.groupby("a", sort=False):
            own = sets[a]
            for b in group["b"].tolist():
                other = sets[b]
                small, large = (own, other) if len(own) < len(other) else (other, own)
                if len(small) * of < pct * len(large):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                if both * of >= pct * (len(own) + len(other) - both):
                    keep.append((a, b))
        return pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("block").cogroup(texts.groupBy("of_block")).applyInPandas(check, "a long, b long")


def prefixes(shingles: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rarest first, within which a set of at most its size must meet it, and how many of them
    a set of its size or more must meet."""
    order = np.lexsort((shingles, counts[shingles % np.uint64(len(counts))]))
    n = len(shingles)
    larger = n - int(np.ceil(threshold * n - 1e-9)) + 1
    smaller = n - int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)) + 1
    return shingles[order[:larger]], smaller


def _first_shingles(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """texts: c, root, n, text. token, c, root, n and whether the token is in the shorter prefix, of every class."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield part, shingle_sets(common.utf8_column(part.column("text")), k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for _, found in sets(batches):
            total += np.bincount((np.concatenate(found) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": at, "count": total[at]})

    table = texts.select("text").mapInArrow(count, "slot long, count long").groupBy("slot").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[table["slot"].to_numpy()] = table["count"].to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in sets(batches):
            own = [prefixes(s, held.value, threshold) for s in found]
            sizes = [len(x) for x, _ in own]
            at = pa.array(np.repeat(np.arange(len(own)), sizes))
            short = np.concatenate([np.arange(len(x)) < m for x, m in own])
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate([x for x, _ in own]).view(np.int64))} | {c: part.column(c).take(at) for c in ("c", "root", "n")} | {"short": pa.array(short)})

    return texts.select("c", "root", "n", "text").mapInArrow(first, "token long, c long, root long, n long, short boolean")


def searched(mixed: DataFrame, own: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """mixed: band, c, root, main of every bucket with several roots. Links between classes of different roots, and the
    written tables that they are read from.

    Members are dealt once, those around one main component together but BLOCK_IDS at a time; a query goes once to each
    block that holds a partner of it by a first shingle, and a block with more than BLOCK_IDS queries is held once for each
    so many. Pairs are never rows: a block compares packed words, then full sets, and gives the links it finds, one for
    each query and root."""
    members = mixed.groupBy("c", "root").agg(F.min("main").alias("near"))
    members = members.join(own.select("c", F.col("doc_id").alias("id_"), F.col("t").alias("t_"), "n", *PACKED), "c")
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("t"))
    found = members.join(texts, (F.col("t_") == F.col("t")) & F.col("id_").eqNullSafe(F.col("doc_id"))).drop("doc_id", "t", "id_", "t_")
    found = common.staged(found.dropDuplicates(["c"]), "searched-texts")
    tokens = _first_shingles(found, k, threshold)
    counts = tokens.groupBy("token", "root").agg(F.count("*").alias("count"), F.max("short").alias("short"))
    main = counts.groupBy("token").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("parts"), F.max("short").alias("any"))
    main = common.staged(main.where("parts > 1 and any").select("token", "main"), "first-shingles")
    near = common.staged(tokens.join(main, "token"), "searched-buckets")
    sizes = found.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / BLOCK_IDS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    n, shingles = found.agg(F.count("*"), F.sum("n")).first()
    n_blocks = max(1, -(-n // BLOCK_IDS), -(-(shingles or 0) // BLOCK_SHINGLES))
    dealt = found.select("c", "root", "near").join(sizes, "near").select("c", "root", F.pmod(F.xxhash64("near") % n_blocks + F.pmod(F.xxhash64("c"), F.col("parts")), F.lit(n_blocks)).cast("int").alias("block"))
    dealt = common.staged(dealt, "dealt")
    there = near.join(dealt.select("c", "block"), "c").groupBy("token", "block").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.when(F.col("short"), F.col("n"))).alias("least"), F.max("n").alias("most"))
    meets = ((F.col("r0") != F.col("root")) | (F.col("r1") != F.col("root"))) & ((F.coalesce("least", F.col("n") + 1) <= F.col("n")) | (F.col("short") & (F.col("most") >= F.col("n"))))
    asks = common.staged(near.where("root <> main").join(there, "token").where(meets).select("c", "root", "block").distinct(), "asks")
    chunks = asks.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_IDS).cast("int").alias("chunks"))
    asking = asks.join(chunks, "block").select("c", "root", "block", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("asks"))
    held = dealt.join(chunks, "block").select("c", "root", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("asks"))
    roles = asking.union(held).groupBy("c", "block", "chunk").agg(F.max("asks").alias("asks"), F.min("asks").alias("only"))
    full = roles.join(found.drop("near"), "c")
    pct, of, low, chance = round(threshold * 10_000), 10_000, least_estimate(threshold), 2.0**-BITS

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("c").reset_index(drop=True)
        sets = shingle_sets([x.encode() for x in block["text"]], k)
        n = block["n"].to_numpy()
        packed = block[PACKED].to_numpy().view(np.uint64)
        # which components are joined so far, in this block
        names, part = np.unique(block["root"].to_numpy(), return_inverse=True)
        members = np.flatnonzero(block["only"].to_numpy() == 0)
        queries = np.flatnonzero(block["asks"].to_numpy() == 1)
        ids, keep = block["c"].to_numpy(), []
        for q in queries.tolist():
            x = packed[members] ^ packed[q]
            differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
            near = ((1 - differ / MINIMA) - chance) / (1 - chance) >= low
            near &= (part[members] != part[q]) & (np.minimum(n[members], n[q]) * of >= pct * np.maximum(n[members], n[q]))
            cand = members[near]
            if not len(cand):
                continue
            size = n[cand]
            flat = np.concatenate([sets[m] for m in cand])
            at = np.searchsorted(sets[q], flat)
            at[at == len(sets[q])] = 0
            both = np.bincount(np.repeat(np.arange(len(cand)), size)[sets[q][at] == flat], minlength=len(cand))
            hit = cand[both * of >= pct * (size + n[q] - both)]
            for m in hit.tolist():
                if part[m] != part[q]:
                    keep.append((ids[q], ids[m]))
                    part[part == part[m]] = part[q]
        return pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    return full.groupBy("block", "chunk").applyInPandas(compare, "a long, b long"), [found, main, near, dealt, asks]


def classes_and_roots(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per document its digest and size; per class (c) its digest, first document, and root class. row_col: numbers
    of the rows, if `docs` has them."""
    sigs = common.staged(_signatures(docs, id_col, text_col, k, row_col), "minhash")
    full = sigs.where("n > 0")
    classes = common.staged(full.groupBy("d0", "d1").agg(F.min("u").alias("c"), F.min("doc_id").alias("first_doc")), "classes")
    own = common.staged(full.join(classes.select(F.col("c").alias("u")), "u").select(F.col("u").alias("c"), "doc_id", "t", "n", "bands", *PACKED), "class-signatures")
    rows = own.select("c", F.explode("bands").alias("band"))
    # the bucket's centre: the member whose number, masked by the bucket's key, is least
    buckets = rows.groupBy("band").agg(F.min(F.col("c").bitwiseXOR(F.col("band"))).alias("x"), F.count("*").alias("m")).where("m > 1")
    buckets = common.staged(buckets, "bucket-centres")
    shared = common.staged(rows.join(buckets, "band").select("band", "c", F.col("x").bitwiseXOR(F.col("band")).alias("p")), "buckets")
    words = own.select("c", "n", *PACKED)
    side = lambda x: words.select(*(F.col(w).alias(x + w) for w in words.columns))
    close = (estimate("a_", "b_") >= least_estimate(threshold)) & (F.least("a_n", "b_n") >= F.floor(threshold * F.greatest("a_n", "b_n")))
    stars = shared.where("c <> p").select(F.col("c").alias("a_c"), F.col("p").alias("b_c")).distinct()
    stars = stars.join(side("a_"), "a_c").join(side("b_"), "b_c").where(close).select(F.col("a_c").alias("a"), F.col("b_c").alias("b"), (F.col("a_n") + F.col("b_n")).alias("size"))
    pairs = common.staged(stars, "star-pairs")
    where = own.select("c", "doc_id", "t")
    used = [own, buckets, shared, pairs]
    links = common.staged(confirmed(pairs, where, docs, id_col, text_col, k, threshold), "links")
    roots = common.staged(components(links), "roots")
    # buckets that hold several components: everything outside the main one against all the others
    named = shared.select("band", "c").join(roots.withColumnRenamed("id", "c"), "c", "left").select("band", "c", F.coalesce("root", "c").alias("root"))
    counts = named.groupBy("band", "root").count()
    main = counts.groupBy("band").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = common.staged(named.join(main, "band"), "mixed-buckets")
    if not mixed.isEmpty():
        more, held = searched(mixed, own, docs, id_col, text_col, k, threshold)
        used += [links, roots, *held]
        links = common.staged(links.union(more), "links")
        roots = common.staged(components(links), "roots")
    out = classes.join(roots.withColumnRenamed("id", "c"), "c", "left").select("d0", "d1", "c", "first_doc", F.coalesce("root", "c").alias("root"))
    out = common.staged(out, "classes-with-roots")
    common.discard(*used, mixed, classes, links, roots)
    return sigs, out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: u (row number), doc_id, t (hash of the text), n_shingles, component_id (smallest id reachable), kept."""
    sigs, classes = classes_and_roots(docs, id_col, text_col, shingle, threshold)
    first = common.staged(classes.groupBy("root").agg(F.min("first_doc").alias("component_id")), "first-documents")
    named = classes.join(first, "root").select("d0", "d1", "component_id")
    out = sigs.select("u", "doc_id", "t", "n", "d0", "d1").join(named, ["d0", "d1"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("u", "doc_id", "t", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` without all but one row of each group: that of the smallest id, nulls last, and among
    equal ids the first row. Rows without shingles stay."""
    rows = common.staged(docs.withColumn("__ls_row", F.monotonically_increasing_id()), "numbered")
    sigs, classes = classes_and_roots(rows, id_col, text_col, shingle, threshold, "__ls_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "u")
    first = sigs.where("n > 0").groupBy("d0", "d1").agg(F.min(order).alias("first"))
    first = first.join(classes.select("d0", "d1", "root"), ["d0", "d1"]).groupBy("root").agg(F.min("first")["u"].alias("u"))
    keep = first.select("u").union(sigs.where("n = 0").select("u"))
    return rows.join(keep.withColumnRenamed("u", "__ls_kept"), F.col("__ls_row") == F.col("__ls_kept"), "left_semi").drop("__ls_row")


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op6_bbit_minhash": op6_bbit_minhash}
ORACLES: dict[str, str] = {}
