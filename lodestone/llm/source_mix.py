"""Mixing sources to target weights: hash-threshold histograms (DataFrame functions only).

Each document gets a fixed 48-bit hash. Tokens are summed by source and by the top 12 bits of the
hash; running sums find, per source, the bucket in which the budget is used up. Only the rows of
that boundary bucket are summed again by their next 12 bits, and so on over four levels, which
resolves the threshold down to single hashes. Documents below the threshold are taken by a plain
filter: nothing is sorted. Thresholds are nested: a larger budget takes a superset.

A target above a source's size is met by repeats: every document is taken floor(target / size)
times and those below the threshold of the remainder once more, so none exceeds `max_repeats`
times its size. The hash depends on doc_id and text alone, so reruns agree.

Scale: the histograms are partially aggregated before each shuffle, a source has at most 4,096 rows
a level whatever its size, and the thresholds (one row a source) are joined by Spark's choice of
join, so a hot source is split by adaptive skew handling.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows
with the same doc_id and text share a hash and are taken together; sources of size 0 have target 0;
an empty table gives an empty table; only doc_id, text and source are read, extra columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common

BITS, LEVELS = 12, 4
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash48(key: Column, text: Column) -> Column:
    """The first 48 bits of the MD5 sum of `key:text`, nulls as empty strings."""
    joined = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """sizes: src, source_size, a row a source. Adds `target`: weighted shares of the whole, no more than
    max_repeats times the source, the excess shared again by weight until none is above.

    With sources in order of cap / weight, those that are capped come first. A source is capped when
    its share of what the capped ones before it leave, by weight, reaches its cap. From the first
    that is not, these shares fall, so the largest of them is the level of all that are not capped. One
    row a source is all that the two windows see."""
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("src").isNull(), F.col("src"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % n + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    total = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), F.col("src"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("all_size", F.sum("source_size").over(total).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(total))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(total))
    )
    return ranked.select("src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _digit(level: int) -> Column:
    return F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def thresholds(keys: DataFrame, budgets: DataFrame) -> DataFrame:
    """keys: src, size, h. budgets: src, budget. Per source the threshold t (long) so that the sizes
    of the rows with h < t come nearest to the budget."""
    state = budgets.select("src", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("left"))
    for level in range(LEVELS):
        rows = keys
        if level:  # of the first level all rows count; from then on, those of the boundary buckets
            bound = state.select(F.col("src").alias("src_"), F.col("prefix").alias("prefix_"))
            rows = keys.join(bound, F.col("src").eqNullSafe(F.col("src_")) & (F.shiftright("h", BITS * (LEVELS - level)) == F.col("prefix_"))).drop("src_", "prefix_")
        sums = rows.groupBy("src", _digit(level).alias("digit")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("src").orderBy("digit")
        state_ = state.select(F.col("src").alias("src_"), "prefix", "left")
        run_sums = sums.withColumn("upto", F.sum("size").over(run)).join(state_, F.col("src").eqNullSafe(F.col("src_"))).drop("src_")
        # the boundary bucket is the first whose running sum passes what is left; without one, all are taken
        edge = run_sums.groupBy("src").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("digit", "size", "upto"))).alias("edge"),
            F.first("prefix").alias("prefix"), F.first("left").alias("left"),
        )
        state = edge.select(
            "src",
            F.when(F.col("edge").isNull(), (F.col("prefix") + 1) * (1 << BITS)).otherwise(F.col("prefix") * (1 << BITS) + F.col("edge.digit")).alias("prefix"),
            F.when(F.col("edge").isNull(), F.lit(0.0)).otherwise(F.col("left") - (F.col("edge.upto") - F.col("edge.size"))).alias("left"),
            *([F.col("edge.size").alias("edge_size")] if level == LEVELS - 1 else []),
        )
        # a row a source; written, so that a level's plan does not hold those before it
        state = common.staged(state, f"mix-level-{level}")
    # at the last level the bucket is one hash: take it if that comes nearer
    return state.select("src", (F.col("prefix") + F.when(F.col("edge_size") - F.col("left") < F.col("left"), 1).otherwise(0)).alias("threshold"))


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return common.staged(
        docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("src"), word_count(docs[text_col]).alias("size"), hash48(docs[id_col], docs[text_col]).alias("h")),
        "mix-keys",
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, src, size, h, source_size, target (of its source), times (0 to max_repeats)."""
    keys = _keys(docs, id_col, text_col, source_col)
    return decide(keys, common.staged(cuts(keys, weights, max_repeats), "mix-cuts"), F.col("src"), F.col("h"))


def cuts(keys: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """keys: src, size, h. Per source (src_): source_size, target, whole (times that every document is taken) and
    threshold (documents below it are taken once more; null: none)."""
    goal = targets(keys.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(max_repeats), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    goal = common.staged(goal.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "mix-goals")
    # no row needs more than max_repeats times its size, so a source at its cap has no remainder
    cut = thresholds(keys.select("src", "size", "h"), goal.where(f"budget > 0 and whole < {max_repeats}"))
    cut = goal.withColumnRenamed("src", "src_").join(cut, F.col("src_").eqNullSafe(F.col("src")), "left")
    return cut.select("src_", "source_size", "target", "whole", "threshold")


def decide(rows: DataFrame, cut: DataFrame, src: Column, h: Column) -> DataFrame:
    """Rows with source_size, target and times (0 to max_repeats)."""
    times = F.col("whole") + F.when(h < F.col("threshold"), 1).otherwise(0)
    return rows.join(cut, src.eqNullSafe(F.col("src_")), "left").withColumn("times", times).drop("src_", "whole", "threshold")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of the mix with the columns of `docs`; a document that is taken n times is there n times."""
    cut = common.staged(cuts(_keys(docs, id_col, text_col, source_col), weights, max_repeats), "mix-cuts")
    cut = cut.select("src_", F.col("whole").alias("__ls_whole"), F.col("threshold").alias("__ls_threshold"))
    times = F.col("__ls_whole") + F.when(hash48(docs[id_col], docs[text_col]) < F.col("__ls_threshold"), 1).otherwise(0)
    rows = docs.join(cut, docs[source_col].eqNullSafe(F.col("src_")), "left").withColumn("__ls_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return rows.drop("src_", "__ls_whole", "__ls_threshold", "__ls_copy")


def op10_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


#: DuckDB: the same targets; the threshold is the hash whose running sum comes nearest to the budget.
ORACLE_SQL = rf"""
WITH k AS (SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 AS weight FROM k GROUP BY src),
b AS (SELECT *, {MAX_REPEATS} * source_size::DOUBLE AS cap,
  coalesce(sum({MAX_REPEATS} * source_size::DOUBLE) OVER e, 0) AS cap_before, coalesce(sum(weight) OVER e, 0) AS weight_before,
  (sum(source_size) OVER ())::DOUBLE AS all_size, sum(weight) OVER () AS all_weight
  FROM s WINDOW e AS (ORDER BY {MAX_REPEATS} * source_size::DOUBLE / weight, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (all_size - cap_before) / (all_weight - weight_before) AS lv FROM b),
g AS (SELECT *, CASE WHEN lv * weight >= cap THEN cap ELSE weight * max(lv) FILTER (lv * weight < cap) OVER () END AS target FROM v),
t AS (SELECT src, source_size, target, CASE WHEN source_size > 0 THEN least({MAX_REPEATS}, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM g),
r AS (SELECT src, h, sum(sum(size)) OVER (PARTITION BY src ORDER BY h) AS upto, sum(size) AS own FROM k GROUP BY src, h),
c AS (SELECT r.src, r.h, r.upto - r.own AS before_, r.own, greatest(0, t.target - t.whole * t.source_size) AS budget FROM r JOIN t ON r.src IS NOT DISTINCT FROM t.src WHERE t.whole < {MAX_REPEATS}),
x AS (SELECT src, h FROM c WHERE budget > 0 AND (before_ + own <= budget OR (before_ <= budget AND before_ + own - budget < budget - before_)))
SELECT k.doc_id, k.size, t.source_size, t.target, (k.size * (t.whole + CASE WHEN x.h IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM k JOIN t ON k.src IS NOT DISTINCT FROM t.src LEFT JOIN x ON k.src IS NOT DISTINCT FROM x.src AND k.h = x.h"""

QUERIES = {"op10_hash_threshold_mix": op10_hash_threshold_mix}
ORACLES = {"op10_hash_threshold_mix": ORACLE_SQL}
