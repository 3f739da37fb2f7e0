"""Quality classifier: interpolated modified Kneser-Ney n-gram model.

The model is of characters (ORDER of them), one for each language, trained on trusted text. N-grams are
counted in every task and summed by key; lower orders count distinct left neighbours; discounts come from the
counts of counts of a language and order; each order's probabilities are joined, sharded by n-gram,
with the totals of their contexts and with the probabilities of the order below. A document's perplexity
is that of its characters by the longest known n-gram, times the weights of the unknown contexts. A
document is kept if its perplexity is not above its language's threshold: the quantile QUANTILE over
the trusted documents of the language that training left out.

Scoring: while the model has at most `max_entries` entries (16 bytes each, counted before), its shards
are sent to the tasks as sorted arrays and texts are scored where they are, without a shuffle. Above
that, documents' distinct n-grams with their counts are joined with the sharded model tables order by order.
Both use the same logarithms (doubles) and give the same perplexities but for the order of the sum.

All trusted text but the held-out documents' is counted and every document is scored whole.

Defined results: null or empty texts have no perplexity and are not kept; a null language is a language of its
own; a language without trusted text has no model: no perplexity, kept; repeated rows are scored
one by one and counted as often as they occur; extra columns stay out; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

ORDER = 5
#: Quantile of the perplexities of held-out trusted documents, chosen by labels (README); one document in HELD_OUT is held out.
QUANTILE, HELD_OUT = 0.96, 5
#: Most model entries that are sent to the tasks.
MAX_ENTRIES = 6_000_000
#: Code points in one NumPy block, distinct n-grams that a counting task holds before it passes them on.
BLOCK_CHARS, HELD_GRAMS = 1_000_000, 1_000_000
START = "\x02"
#: 64-bit words of the table that looks for trusted ids.
BIT_WORDS = 1 << 19
_COMBINE = np.uint64(0x9E3779B97F4A7C15)


def padded(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after order - 1 START marks; the text of each position, -1 for marks."""
    mark = START * (order - 1)
    points = np.frombuffer("".join(mark + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes + order - 1)
    starts = np.cumsum(sizes + order - 1) - sizes - (order - 1)
    for j in range(order - 1):
        owner[starts + j] = -1
    return points, owner


def gram_hash(points: np.ndarray, at: np.ndarray, k: int, context: bool = False) -> np.ndarray:
    """Hash of the k code points that end at each position (of the k before it for a context)."""
    h = np.full(len(at), 2 * k + context, np.uint64)
    first = at - k if context else at - k + 1
    for j in range(k):
        h = h * _COMBINE + points[first + j] + np.uint64(1)
    return common.mix64(h)


def _blocks(texts: list[str | None]):
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    yield from common.blocks(sizes, BLOCK_CHARS)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs: lang, text. lang, gram, n of all n-grams of the top order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
                for lo, hi in _blocks(own):
                    points, owner = padded(own[lo:hi], order)
                    at = np.flatnonzero(owner >= 0)
                    _, one, n = np.unique(gram_hash(points, at, order), return_index=True, return_counts=True)
                    end = at[one]
                    grams = np.stack([points[end - j] for j in range(order - 1, -1, -1)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    for i, c in enumerate(n.tolist()):
                        key = (lang, grams[i * order : (i + 1) * order])
                        held[key] = held.get(key, 0) + c
                    if len(held) > HELD_GRAMS:
                        yield _counted(held)
                        held = {}
        if held:
            yield _counted(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in held], pa.string()), "gram": pa.array([k[1] for k in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def build(counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """counts: lang, gram, n of the top order. For each order from 1: (lang, gram, p) and (lang, ctx, gamma)."""
    tables = {order: common.staged(counts, f"grams-{order}")}
    for k in range(order - 1, 0, -1):
        below = tables[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        tables[k] = common.staged(below, f"grams-{k}")
    probabilities: list[DataFrame] = []
    weights: list[DataFrame] = []
    for k in range(1, order + 1):
        t = tables[k]
        n = {i: F.count(F.when(F.col("n") == i, 1)).cast("double") for i in (1, 2, 3, 4)}
        of = t.groupBy("lang").agg(*(n[i].alias(f"n{i}") for i in n), F.count("*").alias("types"))
        y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

        def discount(i: int, y: Column = y) -> Column:
            d = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
            d = F.least(F.lit(float(i)), F.greatest(F.lit(0.05 * i), d))
            return F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), d).otherwise(F.lit(0.5 * i))

        of = of.select(F.col("lang").alias("lang_"), *(discount(i).alias(f"d{i}") for i in (1, 2, 3)), "types")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = t.join(of, _same("lang", "lang_")).select("lang", "gram", F.substring("gram", 1, k - 1).alias("ctx"), F.substring("gram", 2, k - 1).alias("rest"), "n", d.alias("d"), "types")
        total = rows.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("off"))
        gamma = common.staged(total.select("lang", "ctx", (F.col("off") / F.col("total")).alias("gamma"), "total"), f"gamma-{k}")
        weights.append(gamma.select("lang", "ctx", "gamma"))
        g = gamma.select(F.col("lang").alias("lang_"), F.col("ctx").alias("ctx_"), "gamma", "total")
        rows = rows.join(g, _same("lang", "lang_") & (F.col("ctx") == F.col("ctx_")))
        own = (F.col("n") - F.col("d")) / F.col("total")
        if k == 1:
            p = rows.select("lang", "gram", (own + F.col("gamma") / (F.col("types") + 1)).alias("p"))
            unknown = of.join(g.withColumnRenamed("lang_", "l2"), F.col("lang_").eqNullSafe(F.col("l2"))).select(F.col("lang_").alias("lang"), F.lit("").alias("gram"), (F.col("gamma") / (F.col("types") + 1)).alias("p"))
            p = p.union(unknown)
        else:
            lower = probabilities[-1].select(F.col("lang").alias("l2"), F.col("gram").alias("g2"), F.col("p").alias("p2"))
            p = rows.join(lower, _same("lang", "l2") & (F.col("rest") == F.col("g2"))).select("lang", "gram", (own + F.col("gamma") * F.col("p2")).alias("p"))
        probabilities.append(common.staged(p, f"p-{k}"))
    return probabilities, weights


class Scorer:
    """The model as sorted arrays: by language hashes and log probabilities, hashes and log weights of contexts."""

    def __init__(self, order: int):
        self.order, self.grams, self.contexts, self.unknown = order, {}, {}, {}

    @classmethod
    def gathered(cls, probabilities: list[DataFrame], weights: list[DataFrame]) -> Scorer:
        order = len(probabilities)
        out = cls(order)

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, k, ctx = batch.column("g").to_pylist(), batch.column("k").to_pylist(), batch.column("ctx").to_pylist()
                h = np.zeros(len(text), np.uint64)
                for size, c in {*zip(k, ctx, strict=True)}:
                    i = [j for j, pair in enumerate(zip(k, ctx, strict=True)) if pair == (size, c)]
                    points = np.frombuffer("".join(text[j] for j in i).encode("utf-32-le", "surrogatepass"), np.uint32)
                    end = np.arange(len(i)) * size + size - (0 if c else 1)
                    h[i] = gram_hash(points, end, size, c)
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "ctx": batch.column("ctx"), "h": pa.array(h.view(np.int64)), "v": batch.column("v")})

        rows = None
        for k, (p, g) in enumerate(zip(probabilities, weights, strict=True), 1):
            part = p.where(F.length("gram") == k).select("lang", F.col("gram").alias("g"), F.lit(k).alias("k"), F.lit(False).alias("ctx"), F.log("p").alias("v"))
            if k > 1:
                part = part.union(g.select("lang", F.col("ctx").alias("g"), F.lit(k - 1).alias("k"), F.lit(True).alias("ctx"), F.log("gamma").alias("v")))
            rows = part if rows is None else rows.union(part)
        table = rows.mapInArrow(hashed, "lang string, ctx boolean, h long, v double").toArrow()
        code = table["lang"].combine_chunks().dictionary_encode() if table.num_rows else None
        if code is not None:
            number = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = code.dictionary.to_pylist()
            ctx, h, v = table["ctx"].to_numpy(), table["h"].to_numpy().view(np.uint64), table["v"].to_numpy()
            for i in set(number.tolist()):
                lang = names[i] if i >= 0 else None
                for held, want in ((out.grams, False), (out.contexts, True)):
                    at = np.flatnonzero((number == i) & (ctx == want))
                    at = at[np.argsort(h[at])]
                    held[lang] = (h[at], v[at])
        for r in probabilities[0].where("gram = ''").select("lang", F.log("p").alias("v")).collect():
            out.unknown[r["lang"]] = r["v"]
        return out

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return keys[at] == h, values[at]

    def sums(self, lang: str | None, texts: list[str]) -> np.ndarray:
        """Sum of the log probabilities of each text's characters."""
        out = np.zeros(len(texts))
        for lo, hi in _blocks(texts):
            points, owner = padded(texts[lo:hi], self.order)
            at = np.flatnonzero(owner >= 0)
            if not len(at):
                continue
            _, one, back = np.unique(gram_hash(points, at, self.order), return_index=True, return_inverse=True)
            end = at[one]
            value, todo = np.zeros(len(end)), np.arange(len(end))
            for k in range(self.order, 0, -1):
                found, v = self._look(self.grams[lang], gram_hash(points, end[todo], k))
                value[todo[found]] += v[found]
                todo = todo[~found]
                if not len(todo):
                    break
                if k == 1:
                    value[todo] += self.unknown[lang]
                else:
                    known, v = self._look(self.contexts[lang], gram_hash(points, end[todo], k - 1, True))
                    value[todo[known]] += v[known]
            out[lo:hi] = np.bincount(owner[at], value[back], hi - lo)
        return out


def _scored_by_broadcast(docs: DataFrame, scorer: Scorer) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                total: list[float | None] = [None] * len(texts)
                for lang in set(langs) & set(model.grams):
                    i = [j for j, x in enumerate(langs) if x == lang and texts[j]]
                    for j, s in zip(i, model.sums(lang, [texts[j] for j in i]).tolist(), strict=True):
                        total[j] = s
                cols = [part.column(n) for n in ("doc_id", "lang")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(t) if t else 0 for t in texts], pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "lang", "n_chars", "logp"])

    return docs.mapInArrow(run, f"doc_id {kind}, lang string, n_chars long, logp double")


def _scored_by_joins(docs: DataFrame, probabilities: list[DataFrame], weights: list[DataFrame]) -> DataFrame:
    """The same by joins of every document's distinct n-grams with the sharded tables, from the top order down."""
    order = len(probabilities)
    docs = common.staged(docs.withColumn("row", F.monotonically_increasing_id()), "scored-docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lang, text in zip(*(batch.column(c).to_pylist() for c in ("row", "lang", "text")), strict=True):
                if not text:
                    continue
                points, owner = padded([text], order)
                at = np.flatnonzero(owner >= 0)
                _, one, n = np.unique(gram_hash(points, at, order), return_index=True, return_counts=True)
                whole = START * (order - 1) + text
                grams = [whole[e - order + 1 : e + 1] for e in at[one].tolist()]
                yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(n), pa.int64()), "lang": pa.array([lang] * len(n), pa.string()), "gram": pa.array(grams, pa.string()), "n": pa.array(n, pa.int64())})

    rows = docs.select("row", "lang", "text").mapInArrow(run, "row long, lang string, gram string, n long").withColumn("v", F.lit(0.0)).withColumn("open", F.lit(True))
    for k in range(order, 0, -1):
        p = probabilities[k - 1].select(F.col("lang").alias("l2"), F.col("gram").alias("g2"), F.log("p").alias("p2")).where(F.length("g2") == k)
        rows = rows.join(p, _same("lang", "l2") & (F.substring("gram", order - k + 1, k) == F.col("g2")), "left")
        rows = rows.withColumn("v", F.when(F.col("open") & F.col("p2").isNotNull(), F.col("v") + F.col("p2")).otherwise(F.col("v"))).withColumn("open", F.col("open") & F.col("p2").isNull()).drop("l2", "g2", "p2")
        g = weights[k - 1].select(F.col("lang").alias("l3"), F.col("ctx").alias("c3"), F.log("gamma").alias("w3"))
        if k > 1:
            rows = rows.join(g, _same("lang", "l3") & (F.substring("gram", order - k + 1, k - 1) == F.col("c3")), "left")
            rows = rows.withColumn("v", F.when(F.col("open") & F.col("w3").isNotNull(), F.col("v") + F.col("w3")).otherwise(F.col("v"))).drop("l3", "c3", "w3")
    unknown = probabilities[0].where("gram = ''").select(F.col("lang").alias("l4"), F.log("p").alias("u4"))
    rows = rows.join(unknown, _same("lang", "l4")).withColumn("v", F.when(F.col("open"), F.col("v") + F.col("u4")).otherwise(F.col("v")))
    sums = rows.groupBy("row").agg(F.sum(F.col("n") * F.col("v")).alias("logp"))
    out = docs.select("row", "doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return out.join(sums, "row", "left").drop("row")


def _trusted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ids. A bit table of fixed size, made from the ids' hashes, drops most others
    where they are, so that little more than the trusted texts is exchanged for the exact join."""
    h = F.xxhash64("trusted_id")
    bits = ids.select(F.pmod(h, F.lit(BIT_WORDS)).cast("int").alias("word"), F.shiftrightunsigned(h, 58).cast("int").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    table = np.zeros(BIT_WORDS, np.uint64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(table)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("h").to_numpy()
            found = held.value[np.mod(x, BIT_WORDS)] >> (x.view(np.uint64) >> np.uint64(58)) & np.uint64(1)
            yield batch.filter(pa.array(found.astype(bool)))

    marked = rows.withColumn("h", F.xxhash64("doc_id"))
    some = marked.mapInArrow(maybe, marked.schema).drop("h")
    return some.join(ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi")


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """trusted_ids: doc_id of trusted documents. One row per document: doc_id, lang, n_chars, perplexity, threshold, kept."""
    ids = trusted_ids.select(trusted_ids.columns[0]).distinct().toDF("trusted_id")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    probabilities, weights = build(count_grams(_trusted(rows.where(~held_out), ids), order), order)
    entries = sum(t.count() for t in (*probabilities, *weights))
    if entries <= max_entries:
        scored = _scored_by_broadcast(rows, Scorer.gathered(probabilities, weights))
    else:
        scored = _scored_by_joins(rows, probabilities, weights)
    scored = common.staged(scored.select("doc_id", "lang", "n_chars", F.exp(-F.col("logp") / F.nullif(F.col("n_chars"), F.lit(0))).alias("perplexity")), "perplexities")
    apart = scored.where(held_out & F.col("perplexity").isNotNull()).join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    limits = apart.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    limits = limits.withColumnRenamed("lang", "lang_")
    out = scored.join(limits, _same("lang", "lang_"), "left")
    kept = F.when(F.col("n_chars") == 0, False).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    return classify(common.table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0").select("doc_id"))


QUERIES = {"op2_kneser_ney": op2_kneser_ney}
ORACLES: dict[str, str] = {}
