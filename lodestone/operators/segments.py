"""A stored full-text index in immutable segments: the access path of searches.

A segment holds the passages it was built from, with their tokens, and postings. Every passage has a slot: the segment, the chunk
(at most 2^PIECE_BITS passages that one task has written) and its place there. Postings stand in blocks: up to BLOCK passages of one term and chunk, with slots,
frequencies, lengths and positions as arrays, and the block's highest frequency and least length, which bound every score in it. Blocks are
sorted by (term, slot) and dealt into ranges of that order, so a frequent term is cut over several ranges, and a table of the
ranges' ends tells which of their folders a term needs.

Changes never touch a segment: an upsert writes one new segment and a table of delete marks (slots), and a merge rebuilds small segments
from their stored passages without the marked ones. What is current is named by one manifest, replaced by a rename, so readers see the index
before a change or after it.

Scores need statistics of the passages that are not marked: their number and tokens are kept in the manifest; how many hold a phrase is
counted from the postings that the query reads.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.functions import text as T
from lodestone.functions.splitting import pieces
from lodestone.operators.lexical import MAX_LIMIT, ORDER, _ranked, _spans, filter_conditions, idf, weight
from lodestone.plans import generations
from lodestone.plans.query import ParsedQuery, parse_query, phrase_terms

#: Passages of a block; tokens that a range aims at; sampled postings for each range; segments that are kept before small ones are merged.
BLOCK, RANGE_TOKENS, SAMPLE, MOST_SEGMENTS = 512, 1_000_000, 64, 8
#: Bits of a slot's place in what its task has written, of task and place together, and of the place in its chunk.
PLACE_BITS, CHUNK_BITS, PIECE_BITS = 28, 48, 15
#: Tokens, postings, and terms of queries, that are taken at a time.
PIECE_TOKENS, PIECE_POSTINGS, PIECE_TERMS = 500_000, 200_000, 20_000
#: Passages up to which they are broadcast. They are counted first, as Spark would go by the compressed size of their blocks.
FEW = 20_000
#: Scores closer than this count as equal when blocks are passed over; final ranks compare the scores themselves.
SLACK = 1e-9
POSTINGS = "range int, term string, slot long, size int, data binary"
BLOCKS = "range int, term string, chunk long, size int, most int, least int, slots array<long>, counts array<int>, lengths array<int>, positions array<array<int>>"


def slots(number: int):
    """The slot of a row of segment `number`, for the task that writes it."""
    at = F.monotonically_increasing_id()
    return F.lit(number << CHUNK_BITS).bitwiseOR(F.shiftleft(F.shiftright(at, 33), PLACE_BITS)).bitwiseOR(at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def _shifted(positions: Column, k: int) -> Column:
    return F.transform(positions, lambda x: x - k)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2^35 as bytes, 7 bits in each and the top bit where more follow; and where each number begins, with the end."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    at = np.r_[0, np.cumsum(size)]
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, at


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each begins."""
    first = np.flatnonzero(np.r_[True, data[:-1] < 128][: len(data)])
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.r_[first, len(data)]))
    return (np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first) if len(first) else np.zeros(0, np.int64)), first


def postings(tokens: DataFrame, ends: list[tuple[str, int]]) -> DataFrame:
    """tokens: slot, tokens. A row for each range, term and chunk of a batch, so that a frequent term's passages are one row: the first slot, the number
    of passages, and as varints their slots' differences, lengths, counts and positions' differences. ends: sorted (term, slot) at which a new range begins."""
    terms, places = [t for t, _ in ends], np.array([s for _, s in ends], np.int64)

    def rows(batch):
        slot = np.asarray(batch.column("slot"))
        if (slot[1:] < slot[:-1]).any():
            batch = batch.take(pa.array(np.argsort(slot)))
            slot = np.asarray(batch.column("slot"))
        lists = batch.column("tokens")
        size = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            return None
        code, row = np.asarray(flat.indices), np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.argsort(code, kind="stable")  # within a term by passage and position, as they stood
        code, row = code[order], row[order]
        position = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size))[order]
        new = np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]
        step = np.diff(position, prepend=0)
        step[new] = position[new]
        first = np.flatnonzero(new)
        code, slot, length = code[first], slot[row[first]], size[row[first]]
        words = flat.dictionary.to_pylist()
        lo, hi = (np.array([f(terms, w) for w in words], np.int32) for f in (bisect_left, bisect_right))
        part = lo[code]
        for w in np.flatnonzero(hi > lo):  # terms that a range ends in
            own = slice(*np.searchsorted(code, [w, w + 1]))
            part[own] += np.searchsorted(places[lo[w] : hi[w]], slot[own], side="right").astype(np.int32)
        chunk = slot >> PIECE_BITS
        new = np.r_[True, (code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (chunk[1:] != chunk[:-1])]
        head = np.flatnonzero(new)
        gap = np.diff(slot, prepend=0)
        gap[head] = 0
        n, upto = np.diff(np.r_[head, len(code)]), np.r_[first, len(position)]
        held = upto[np.r_[head[1:], len(code)]] - first[head]  # positions of a row
        base = np.cumsum(3 * n + held) - 3 * n - held
        values = np.zeros(int((3 * n + held).sum()), np.int64)
        at = np.repeat(base - head, n) + np.arange(len(code))
        for k, x in enumerate((gap, length, np.diff(upto))):
            values[at + k * np.repeat(n, n)] = x
        values[np.repeat(base + 3 * n - first[head], held) + np.arange(len(position))] = step
        data, where = varints(values)
        offsets = np.r_[where[base], len(data)].astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(part[head], pa.int32()), flat.dictionary.take(pa.array(code[head])), pa.array(slot[head]), pa.array(n, pa.int32()), data], ["range", "term", "slot", "size", "data"])

    def run(batches):
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column("tokens")).fill_null(0))
            for lo, hi in pieces(size + 1, PIECE_TOKENS):
                if (out := rows(batch.slice(lo, hi - lo))) is not None:
                    yield out

    return tokens.select("slot", "tokens").mapInArrow(run, POSTINGS)


def blocks(sorted_postings: DataFrame, most: int = BLOCK) -> DataFrame:
    """Runs of one range, term and chunk in rows of `postings` that stand in the order of range, term and slot, cut to `most` passages; a batch's end also cuts."""

    def rows(batch):
        n = np.asarray(batch.column("size")).astype(np.int64)
        data = batch.column("data")
        where = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        values, begin = from_varints(np.frombuffer(data.buffers()[2], np.uint8)[where[0] : where[-1]])
        base = np.searchsorted(begin, where[:-1] - where[0])
        head, total = np.cumsum(n) - n, int(n.sum())
        at = np.repeat(base - head, n) + np.arange(total)
        gap, length, count = (values[at + k * np.repeat(n, n)] for k in range(3))
        held = np.diff(np.r_[base, len(values)]) - 3 * n
        step = values[np.repeat(base + 3 * n - np.cumsum(held) + held, held) + np.arange(int(held.sum()))]
        added = lambda x, first, size: (c := np.cumsum(x)) - np.repeat(c[first] - x[first], size)  # noqa: E731  sums that begin anew at each first
        upto = np.r_[0, np.cumsum(count)]
        position = added(step, upto[:-1], count)
        slot = added(gap, head, n) + np.repeat(np.asarray(batch.column("slot")), n)
        row = np.repeat(np.arange(len(n)), n)
        part, code = np.asarray(batch.column("range"))[row], np.asarray(batch.column("term").dictionary_encode().indices)[row]
        chunk = slot >> PIECE_BITS
        new = np.r_[True, (part[1:] != part[:-1]) | (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])]
        run_start = np.maximum.accumulate(np.where(new, np.arange(total), 0))
        first = np.flatnonzero(new | ((np.arange(total) - run_start) % most == 0))
        offsets = pa.array(np.r_[first, total], pa.int32())
        at = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(position, pa.int32()))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(slot), pa.array(count, pa.int32()), pa.array(length, pa.int32()), at)]
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), batch.column("term").take(pa.array(row[first])), pa.array(chunk[first]), pa.array(np.diff(np.r_[first, total]), pa.int32()), pa.array(np.maximum.reduceat(count, first), pa.int32()), pa.array(np.minimum.reduceat(length, first), pa.int32()), *lists], names)

    def run(batches):
        for batch in batches:
            for lo, hi in pieces(np.asarray(batch.column("size")).astype(np.int64), PIECE_POSTINGS):
                yield rows(batch.slice(lo, hi - lo))

    return sorted_postings.mapInArrow(run, BLOCKS)


def queries_of(batch, most: int = PIECE_TERMS):
    """Lists of (query_id, need, terms) of a batch with about `most` terms each: a term as a Python object takes many times its bytes."""
    size = np.asarray(pa.compute.list_value_length(batch.column("terms")).fill_null(0)).astype(np.int64)
    for lo, hi in pieces(size + 1, most):
        some = batch.slice(lo, hi - lo)
        yield list(zip(*(some.column(c).to_pylist() for c in ("query_id", "need", "terms")), strict=True))


class TextIndex:
    """The index under a path; an instance sees it as its manifest was when the instance was made."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK, range_tokens: int = RANGE_TOKENS):
        self.spark, self.path, self.block, self.range_tokens = spark, path, block, range_tokens
        self.state = generations.manifest(spark, path) or {"segments": [], "marks": [], "next": 1, "source": None}

    # ---- changes

    def _segment(self, passages: DataFrame, number: int) -> dict:
        """Write a segment of passages (with passage_text) and say what it holds."""
        name = f"segment-{number}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/{name}"
        kept = [c for c in passages.columns if c not in ("slot", "tokens", "n_tokens")]
        rows = passages.select(slots(number).alias("slot"), *kept, T.tokenize_fts(F.col("passage_text")).alias("tokens"))
        rows.withColumn("n_tokens", F.size("tokens")).write.parquet(f"{at}/passages", compression="zstd")
        stored = self.spark.read.parquet(f"{at}/passages")
        held = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
        chunks = [r[0] for r in stored.select(F.shiftright("slot", PIECE_BITS)).distinct().collect()]  # one for 2^PIECE_BITS passages, and one more a written file
        n_ranges = max(1, -(-held["tokens"] // self.range_tokens))
        ends = self._ends(stored, n_ranges, held["n"], held["tokens"])
        dealt = postings(stored, ends).repartitionById(len(ends) + 1, "range").sortWithinPartitions("range", "term", "slot")
        blocks(dealt, self.block).write.partitionBy("range").parquet(f"{at}/postings", compression="zstd")
        if held["tokens"]:
            back = self.spark.read.schema(BLOCKS).parquet(f"{at}/postings")
            back.groupBy("range").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("blocks")).write.parquet(f"{at}/ranges")
        return {"name": name, "passages": held["n"], "tokens": held["tokens"], "chunks": sorted(chunks)}

    def _ends(self, stored: DataFrame, n_ranges: int, n: int, tokens: int) -> list[tuple[str, int]]:
        """Ends of ranges of about equal tokens, from about SAMPLE * n_ranges sampled passages and, of their terms, at most twice as many (they set the
        balance alone). Terms are drawn where they are: an order by hash would bring as many from every task to the driver."""
        if n_ranges == 1:
            return []
        fraction = min(1.0, SAMPLE * n_ranges / max(1, n))
        some = stored.sample(fraction=fraction, seed=1).select(F.explode(F.array_distinct("tokens")).alias("term"), "slot")
        some = sorted((r["term"], r["slot"]) for r in some.sample(fraction=min(1.0, 2 * SAMPLE * n_ranges / (fraction * tokens)), seed=2).collect())
        return sorted({some[len(some) * i // n_ranges] for i in range(1, n_ranges)}) if some else []

    def _publish(self, **changes) -> TextIndex:
        self.state = self.state | changes
        generations.replace_manifest(self.spark, self.path, self.state)
        return self

    def _mark(self, marked: DataFrame) -> list[dict]:
        """Write delete marks (slot, n_tokens)."""
        name = f"marks-{uuid.uuid4().hex[:12]}"
        marked.select("slot", "n_tokens").write.parquet(f"{self.path}/{name}")
        n = self.spark.read.parquet(f"{self.path}/{name}").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        return [*self.state["marks"], {"name": name, "passages": n[0], "tokens": n[1]}] if n[0] else self.state["marks"]

    def upsert(self, passages: DataFrame, source: str | None = None) -> TextIndex:
        """Passages of new or changed artifacts: those of the same artifacts that are there are marked as deleted; one segment is written."""
        marks = self.state["marks"]
        if self.state["segments"]:
            marks = self._mark(self.passages().join(passages.select("artifact_id").distinct(), "artifact_id", "left_semi"))
        segment = self._segment(passages, self.state["next"])
        self._publish(segments=[*self.state["segments"], segment], marks=marks, next=self.state["next"] + 1, source=source)
        return self.merge() if len(self.state["segments"]) > MOST_SEGMENTS else self

    def delete(self, artifacts: DataFrame) -> TextIndex:
        """Mark all passages of artifacts (artifact_id)."""
        return self._publish(marks=self._mark(self.passages().join(artifacts.select("artifact_id").distinct(), "artifact_id", "left_semi")))

    def merge(self, keep: int = MOST_SEGMENTS // 2) -> TextIndex:
        """Rebuild all but the `keep` largest segments as one, without marked passages; marks of what is gone go too."""
        ordered = sorted(self.state["segments"], key=lambda s: (-s["passages"], s["name"]))
        large, small = ordered[:keep], ordered[keep:]
        if len(small) < 2:
            return self
        rows = self._unmarked(self._read("passages", small))
        segment = self._segment(rows, self.state["next"])
        numbers = [c >> (CHUNK_BITS - PIECE_BITS) for s in large for c in s["chunks"][:1]]
        marks = self.state["marks"]
        if marks:
            left = self._marks().where(F.shiftright("slot", CHUNK_BITS).isin(numbers))
            self.state["marks"] = []
            marks = self._mark(left)
        return self._publish(segments=[*large, segment], marks=marks, next=self.state["next"] + 1)

    # ---- reading

    def _read(self, table: str, segments: list[dict] | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{s['name']}/{table}" for s in (self.state["segments"] if segments is None else segments)))

    def _marks(self) -> DataFrame:
        return self.spark.read.schema("slot long, n_tokens int").parquet(*(f"{self.path}/{m['name']}" for m in self.state["marks"]))

    def _unmarked(self, rows: DataFrame) -> DataFrame:
        few = sum(m["passages"] for m in self.state["marks"]) <= FEW
        return rows.join(self._marks().select("slot").hint("broadcast" if few else "merge"), "slot", "left_anti") if self.state["marks"] else rows

    def passages(self) -> DataFrame:
        """slot, the columns of the passages that were indexed, tokens and n_tokens; without those that are marked."""
        return self._unmarked(self._read("passages"))

    def statistics(self) -> tuple[int, int]:
        """Passages and tokens that are not marked."""
        return tuple(sum(s[k] for s in self.state["segments"]) - sum(m[k] for m in self.state["marks"]) for k in ("passages", "tokens"))

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """Postings blocks of all terms, or of some: then only folders of ranges that can hold them are read. Marks are not looked at."""
        schema, folders = BLOCKS.removeprefix("range int, "), []
        held = [f"{self.path}/{s['name']}" for s in self.state["segments"] if s["tokens"]]
        if held and terms is None:
            return reduce(DataFrame.union, [self.spark.read.schema(BLOCKS).parquet(f"{at}/postings").drop("range") for at in held])
        for at in held:
            ranges = self.spark.read.schema("range int, first string, last string, blocks long").parquet(f"{at}/ranges")
            fits = reduce(lambda a, b: a | b, [(F.col("first") <= t) & (F.col("last") >= t) for t in terms])
            folders += [f"{at}/postings/range={r['range']}" for r in ranges.where(fits).select("range").collect()]  # ranges of the query's terms
        return self.spark.read.schema(schema).parquet(*folders).where(F.col("term").isin(terms)) if folders else self.spark.createDataFrame([], schema)

    def _postings(self, found: DataFrame, positions: bool = True) -> DataFrame:
        """Blocks as rows: term, slot, count, length, positions; without marked passages."""
        columns = ["slots", "counts", "lengths", *(["positions"] if positions else [])]
        rows = found.select("term", F.inline(F.arrays_zip(*columns))).withColumnsRenamed({"slots": "slot", "counts": "count", "lengths": "length"})
        return self._unmarked(rows)

    def vocabulary(self) -> DataFrame:
        """term, doc (passages) and cnt (occurrences)."""
        if self.state["marks"]:
            return self._postings(self.blocks(), False).groupBy("term").agg(F.count("*").alias("doc"), F.sum("count").alias("cnt"))
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        return self.blocks().groupBy("term").agg(F.sum("size").alias("doc"), F.sum(total).alias("cnt"))

    # ---- search

    def _scored(self, matched: DataFrame, counts: DataFrame, phrases: list[list[str]]) -> DataFrame:
        """slot, bm25 and the starts of each phrase."""
        n, tokens = self.statistics()
        rows = matched.crossJoin(F.broadcast(counts))  # one row
        score = reduce(lambda a, b: a + b, [idf(F.lit(float(n)), F.col(f"df_{i}")) * weight(F.size(f"starts_{i}").cast("double"), F.col("length"), F.lit(tokens / max(1, n))) for i in range(len(phrases))])
        return rows.select("slot", (-score).alias("bm25"), *(f"starts_{i}" for i in range(len(phrases))))

    def _stored(self) -> DataFrame:
        """The passages as they were written, with a confidence."""
        rows = self._read("passages").drop("tokens", "n_tokens", "text")
        return rows if "confidence" in rows.columns else rows.withColumn("confidence", F.lit(1.0))

    def _filtered(self, scored: DataFrame, parsed: ParsedQuery, most: int) -> DataFrame:
        """Of passages that pass the filters, what their order needs. most: a bound of the scored ones, counted before, which says whether they are sent to
        the passages or both are exchanged."""
        rows = self._stored()
        for c in (F.col("enabled"), *filter_conditions(parsed.filters)):
            rows = rows.where(c)
        return scored.hint("broadcast" if most <= FEW else "merge").join(rows.select("slot", *(c for c in ORDER if c != "bm25")), "slot")

    def _single(self, term: str, parsed: ParsedQuery, limit: int) -> DataFrame:
        """One term: blocks whose bound is under the k-th best score of the most promising ones are passed over."""
        n, tokens = self.statistics()
        found = self.blocks([term])
        held = lambda some: some.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        df = float(self._postings(found, False).count() if self.state["marks"] else held(found))
        one = self.spark.range(1).select(F.lit(df).alias("df_0"))
        bound = idf(F.lit(float(n)), F.lit(df)) * weight(F.col("most").cast("double"), F.col("least"), F.lit(tokens / max(1, n)))
        found = found.withColumn("bound", bound)
        hits = lambda some, most: self._filtered(self._scored(self._postings(some).withColumnRenamed("positions", "starts_0"), one, [[term]]), parsed, most)
        n_first = 4 + 4 * limit // self.block
        first = found.orderBy(F.desc("bound"), F.desc("size")).limit(n_first)
        best = hits(first, n_first * self.block).select("bm25").orderBy("bm25").limit(limit).agg(F.count("*"), F.max("bm25")).first()
        if best[0] == limit:
            found = found.where(F.col("bound") >= -best[1] - SLACK)
        return hits(found, held(found))

    def search(self, query: str | ParsedQuery, limit: int = 20) -> DataFrame:
        """The hits of `lexical.search` over the passages of the index, best first: their columns, bm25, score, rank and spans."""
        parsed = parse_query(query) if isinstance(query, str) else query
        phrases = [t for t in map(phrase_terms, parsed.phrases) if t]
        limit = max(1, min(limit, MAX_LIMIT))
        if len(phrases) == 1 and len(phrases[0]) == 1 and self.state["segments"]:
            top = _ranked(self._single(phrases[0][0], parsed, limit), limit)
        else:
            terms = list(dict.fromkeys(w for t in phrases for w in t))
            found = self.blocks(terms)
            df = dict(found.groupBy("term").agg(F.sum("size")).collect())  # a row a term of the query
            rows = self._postings(found).groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.max("length").alias("length"))
            for i, t in enumerate(phrases):
                places = [_shifted(F.try_element_at("at", F.lit(w)), k) for k, w in enumerate(t)]
                rows = rows.withColumn(f"starts_{i}", F.coalesce(F.array_sort(reduce(F.array_intersect, places)), F.array().cast("array<int>")))
            counts = rows.agg(*(F.count_if(F.size(f"starts_{i}") > 0).cast("double").alias(f"df_{i}") for i in range(len(phrases))))
            hit = rows.where(reduce(lambda a, b: a & b, [F.size(f"starts_{i}") > 0 for i in range(len(phrases))]))
            top = _ranked(self._filtered(self._scored(hit, counts, phrases), parsed, min(df.get(w, 0) for w in terms)), limit)
        spans = F.concat(*(_spans(f"starts_{i}", len(t)) for i, t in enumerate(phrases)))
        top = top.select("slot", "bm25", "rank", "score", spans.alias("spans"))
        rows = top.collect()  # at most `limit`
        whole = self._stored().where(F.col("slot").isin([r["slot"] for r in rows]))  # none where there are no hits
        return F.broadcast(self.spark.createDataFrame(rows, top.schema)).join(whole, "slot")

    # ---- a table of queries

    def ranked(self, queries: DataFrame, limit: int, by: str = "passage_id") -> DataFrame:
        """queries: query_id, tokens and need (how many of its distinct tokens a passage must hold; 1: any). For each query the `limit`
        groups (by: passage_id or artifact_id) of its best passage by the sum of BM25 over its tokens, among enabled passages: query_id,
        by, bm25 (negative, rounded to 9 places), passage_id of the best passage and rank; ties go to the smaller id.

        Blocks of the queries' terms go to their chunks, and so does every query with the weights of its terms; a chunk adds
        up one query after the other over an array of its passages and leaves the best of each, so that what is exchanged last
        is bounded by queries, limit and chunks. A frequent term is spread over the chunks, and nothing is broadcast."""
        n, tokens = self.statistics()
        kinds = {c: self._read("passages").schema[c].dataType.simpleString() for c in {"passage_id", by}} if self.state["segments"] else {"passage_id": "string", by: "string"}
        kinds["query_id"] = queries.schema["query_id"].dataType.simpleString()
        out = f"query_id {kinds['query_id']}, by {kinds[by]}, passage_id {kinds['passage_id']}, bm25 double"
        each = queries.select("query_id", "need", F.explode(F.array_distinct("tokens")).alias("term"))
        if not n:
            return self.spark.createDataFrame([], f"query_id {kinds['query_id']}, {by} {kinds[by]}, bm25 double, rank long" + (f", passage_id {kinds['passage_id']}" if by != "passage_id" else ""))
        wanted = each.select("term").distinct()
        held = self.blocks().join(wanted, "term", "left_semi")
        df = (self._postings(held, False).groupBy("term").agg(F.count("*")) if self.state["marks"] else held.groupBy("term").agg(F.sum("size"))).toDF("term", "df")
        terms = each.join(df, "term", "left").select("query_id", "need", F.struct("term", idf(F.lit(float(n)), F.col("df").cast("double")).alias("idf")).alias("t"))
        asked = terms.groupBy("query_id", "need").agg(F.collect_list("t").alias("terms"))
        chunks = F.array(*(F.lit(c).cast("long") for s in self.state["segments"] for c in s["chunks"]))
        n_chunks = max(1, sum(len(s["chunks"]) for s in self.state["segments"]))  # what a task sorts and holds is bounded by the chunk, not the input
        empty = lambda **k: [F.lit(None).cast(v).alias(n) for n, v in k.items()]
        nothing = empty(slots="array<long>", counts="array<int>")
        of_passage = [F.col("slot").alias("slot"), F.col("n_tokens").alias("length"), F.col(by).alias("by"), F.col("passage_id").alias("passage_id")]
        no_passage, no_query = empty(slot="long", length="int", by=kinds[by], passage_id=kinds["passage_id"]), empty(query_id=kinds["query_id"], need="int", terms="array<struct<term:string,idf:double>>")
        own = self.passages().where("enabled").select(F.shiftright("slot", PIECE_BITS).alias("chunk"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("term"), *nothing, *of_passage, *no_query)
        some = held.select("chunk", F.lit(1).alias("kind"), "term", "slots", "counts", *no_passage, *no_query)
        ask = asked.select(F.explode(chunks).alias("chunk"), F.lit(2).alias("kind"), F.lit(None).cast("string").alias("term"), *nothing, *no_passage, "query_id", "need", "terms")
        average, k1, b = tokens / n, 1.2, 0.75

        def run(batches):
            at = None
            slot, length, group, passage, lists, ready = [], [], [], [], {}, False
            for batch in batches:
                chunk, kind = np.asarray(batch.column("chunk")), np.asarray(batch.column("kind"))
                for lo, hi in zip(bounds := np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])]), [*bounds[1:], len(kind)], strict=True):
                    part = batch.slice(lo, hi - lo)
                    if chunk[lo] != at:
                        at, slot, length, group, passage, lists, ready = chunk[lo], [], [], [], [], {}, False
                    if kind[lo] == 0:
                        slot.append(np.asarray(part.column("slot")))
                        length.append(np.asarray(part.column("length")))
                        group.append(part.column("by"))
                        passage.append(part.column("passage_id"))
                        continue
                    if not ready:
                        ready = True
                        slot = np.concatenate([np.zeros(0, np.int64), *slot])
                        order = np.argsort(slot)
                        slot, length = slot[order], np.concatenate([np.zeros(0, np.int32), *length])[order]
                        by_passage = [x for a in passage for x in a.to_pylist()]
                        by_group = [x for a in group for x in a.to_pylist()]
                        by_passage, by_group = ([x[i] for i in order] for x in (by_passage, by_group))
                        number = {g: i for i, g in enumerate(sorted(set(by_group)))}  # groups in the order of ties
                        names, of_group = list(number), np.array([number[g] for g in by_group], np.int64)
                        name_order = np.argsort(sorted(range(len(by_passage)), key=by_passage.__getitem__))
                    if kind[lo] == 1:
                        for term, *two in zip(part.column("term").to_pylist(), *(part.column(c) for c in ("slots", "counts")), strict=True):
                            s, f = (np.asarray(x.values) for x in two)
                            place = np.searchsorted(slot, s)
                            place[place == len(slot)] = 0
                            known = slot[place] == s if len(slot) else np.zeros(len(s), bool)  # disabled and marked ones are not there
                            place, f = place[known], f[known].astype(np.float64)
                            lists.setdefault(term, []).append((place, f * (k1 + 1) / (f + k1 * (1 - b + b * length[place] / average))))
                        continue
                    total, count = np.zeros(len(slot)), np.zeros(len(slot), np.int32)
                    for piece in queries_of(part):
                        found = {"query_id": [], "by": [], "passage_id": [], "bm25": []}
                        for query, need, of in piece:
                            total[:], count[:] = 0, 0
                            for t in sorted(of, key=lambda t: t["term"]):
                                for place, w in lists.get(t["term"], ()):
                                    total[place] += t["idf"] * w
                                    count[place] += 1
                            hit = np.flatnonzero(count >= max(1, need))
                            if not len(hit):
                                continue
                            score = np.round(total[hit], 9)
                            order = np.lexsort((name_order[hit], -score, of_group[hit]))  # the best passage of each group
                            hit, score = hit[order], score[order]
                            first = np.flatnonzero(np.r_[True, of_group[hit][1:] != of_group[hit][:-1]])
                            top = first[np.lexsort((of_group[hit[first]], -score[first]))[:limit]]
                            found["query_id"] += [query] * len(top)
                            found["by"] += [names[of_group[i]] for i in hit[top]]
                            found["passage_id"] += [by_passage[i] for i in hit[top]]
                            found["bm25"] += (-score[top]).tolist()
                        yield pa.RecordBatch.from_pydict(found, schema=wire)

        wire = to_arrow_schema(StructType.fromDDL(out))
        best = own.union(some).union(ask).repartition(n_chunks, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, out)
        whole = best.groupBy("query_id", "by").agg(F.min(F.struct("bm25", "passage_id")).alias("m")).select("query_id", "by", "m.*")
        w = Window.partitionBy("query_id").orderBy("bm25", "by")
        top = whole.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
        return top.select("query_id", F.col("by").alias(by), "bm25", "rank", *(["passage_id"] if by != "passage_id" else []))
