"""Evaluation of retrieval: judged hits and anchors, metrics with null on a zero denominator, failure taxonomy, ablation, gates, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import semantic
from lodestone.operators.segments import TextIndex
from lodestone.operators.vectors import VectorStore, embedded
from lodestone.plans import canonical as C
from lodestone.plans.storage import discard, written

TOP, KEYWORDS, CANDIDATES = 5, 6, 20
#: Pairs of an item and an artifact up to which the artifacts' ids are broadcast (8 bytes each).
FEW = 1_000_000
#: Characters, or pixels of height, of a bin in which expected and found anchors meet.
BIN = 2048
ANCHOR = ("kind", "page", "first", "last", "x", "y", "width", "height")


# ---- anchors


def text_anchor(first: Column, last: Column) -> list[Column]:
    """The columns of a text anchor: characters first to last (exclusive)."""
    none = F.lit(None).cast("int")
    return [F.lit("text").alias("kind"), none.alias("page"), first.cast("long").alias("first"), last.cast("long").alias("last"), *(none.alias(n) for n in ANCHOR[4:])]


def anchors_met(expected: DataFrame, found: DataFrame, keys: list[str], bins: int = BIN) -> DataFrame:
    """Both: keys and ANCHOR. Pairs of an expected anchor and a found one of the same keys, kind and page that covers it: characters for
    `text` and `pdf_page`, the rectangle for `image_region`. Columns: keys, want (struct) and have (struct).

    An interval join: an expected anchor stands in the bin that it begins in, a found one in all bins that it reaches, so a
    document with many anchors is cut over its bins and every pair meets once."""
    region = F.col("kind") == "image_region"
    low, high = F.when(region, F.col("y")).otherwise(F.col("first")), F.when(region, F.col("y") + F.col("height")).otherwise(F.col("last"))
    anchor = F.struct(*ANCHOR)
    want = expected.select(*keys, "kind", "page", F.floor(low / bins).alias("bin"), anchor.alias("want"))
    have = found.select(*keys, "kind", "page", F.explode(F.sequence(F.floor(low / bins), F.floor(high / bins))).alias("bin"), anchor.alias("have"))
    same = [want[c] == have[c] for c in (*keys, "kind", "bin")] + [want["page"].eqNullSafe(have["page"])]
    inside = lambda w, h: (h["first"] <= w["first"]) & (h["last"] >= w["last"])
    within = lambda w, h: (h["x"] <= w["x"]) & (h["y"] <= w["y"]) & (h["x"] + h["width"] >= w["x"] + w["width"]) & (h["y"] + h["height"] >= w["y"] + w["height"])
    covers = F.when(want["kind"] == "image_region", within(F.col("want"), F.col("have"))).otherwise(inside(F.col("want"), F.col("have")))
    return want.join(have, same).where(covers).select(*(want[k] for k in keys), "want", "have")


def texts_of(artifacts: DataFrame, near: DataFrame) -> DataFrame:
    """artifact_id and text of enabled artifacts, of those alone that near (a written table) names while it has at most FEW rows: their ids are
    broadcast, so that other texts stay where they are. With more rows all texts are left for the join."""
    texts = artifacts.where("enabled").select("artifact_id", "text")
    return texts.join(F.broadcast(near.select("artifact_id").distinct()), "artifact_id", "left_semi") if near.count() <= FEW else texts


def expected_anchors(index: TextIndex, artifacts: DataFrame, items: DataFrame) -> DataFrame:
    """items: item_id, text. Where the enabled artifacts (artifact_id, enabled, text) hold an item word for word: item_id, artifact_id, ANCHOR of
    its first place there, and main, true for the smallest artifact; the others are acceptable alternatives.

    An artifact that holds an item holds its rarest word, so candidates come from that word's postings (first and last words may be
    part of longer ones and are used only where an item has no others). The rarest words are written first and then choose the
    postings, and the candidates the texts, so that neither other words' slots nor other texts are exchanged."""
    w = items.select("item_id", "text", T.tokenize_fts(F.col("text")).alias("w"))
    inner = F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.size("w") - 2)).otherwise(F.col("w"))
    each = w.select("item_id", F.explode(F.array_distinct(inner)).alias("term"))
    df = index.blocks().select("term", "size").join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("size").alias("df"))
    rarest = written(each.join(df, "term", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("term")), "rarest")
    at = index.blocks().select("term", "slots").join(rarest, "term").select("item_id", F.explode("slots").alias("slot"))
    near = written(at.join(index.passages().where("enabled").select("slot", "artifact_id"), "slot").select("item_id", "artifact_id").distinct(), "near")
    discard(rarest)
    both = near.join(items.select("item_id", F.col("text").alias("contains")), "item_id").join(texts_of(artifacts, near), "artifact_id")
    place = F.instr("text", F.col("contains"))
    both = both.select("item_id", "artifact_id", place.alias("at"), F.length("contains").alias("n")).where("at > 0")
    main = F.col("artifact_id") == F.min("artifact_id").over(Window.partitionBy("item_id"))
    return both.select("item_id", "artifact_id", *text_anchor(F.col("at") - 1, F.col("at") - 1 + F.col("n")), main.alias("main"))


# ---- queries and their hits


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, text, source_type."""
    return benchmark.select("item_id", T.normalized_lines(F.col("text")).alias("text"), F.when(F.length("text") % 2 == 0, "long_form").otherwise("short_form").alias("source_type"))


def query_table(items: DataFrame) -> DataFrame:
    """Two queries for each item: `main`, all of its words in one passage, as in a search; `again`, its reformulation: half of its KEYWORDS longest words."""
    w = F.array_distinct(T.tokenize_fts(F.col("text")))
    longest = F.transform(F.slice(F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1, KEYWORDS), lambda s: s["x"])
    id_of = lambda kind: F.concat_ws(":", F.lit(kind), "item_id")
    main = items.select(id_of("main").alias("query_id"), w.alias("tokens"), F.size(w).alias("need"))
    again = items.select(id_of("again").alias("query_id"), longest.alias("tokens"), F.ceil(F.size(longest) / 2).cast("int").alias("need"))
    return main.union(again)


def results(index: TextIndex, artifacts: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item: source_type, negative (no artifact holds it), returned, false_positives, first_right (rank of the first hit from an
    artifact that holds it), anchor (whether the passage of such a hit covers the item's place) and again (whether the reformulation has
    such a hit; null for negatives). Hits are the TOP artifacts by the score of their best passage."""
    expected = written(expected_anchors(index, artifacts, items), "expected")
    hits = written(index.ranked(query_table(items), TOP, "artifact_id"), "hits")
    named = hits.select(F.split("query_id", ":")[0].alias("query"), F.split("query_id", ":")[1].cast("long").alias("item_id"), "artifact_id", "rank", "passage_id")
    judged = named.join(expected.select("item_id", "artifact_id", F.lit(True).alias("right")), ["item_id", "artifact_id"], "left")
    main, right = F.col("query") == "main", F.coalesce("right", F.lit(False))
    per = judged.groupBy("item_id").agg(F.count_if(main).alias("returned"), F.count_if(main & ~right).alias("false_positives"), F.min(F.when(main & right, F.col("rank"))).alias("first_right"), F.bool_or(~main & right).alias("again"))
    places = index.passages().select("passage_id", "char_start", "char_end")
    found = named.where("query = 'main'").join(places, "passage_id").select("item_id", "artifact_id", *text_anchor(F.col("char_start"), F.col("char_end")))
    met = anchors_met(expected, found, ["item_id", "artifact_id"]).select("item_id").distinct().withColumn("anchor", F.lit(True))
    positive = expected.select("item_id").distinct().withColumn("positive", F.lit(True))
    out = items.select("item_id", "source_type").join(positive, "item_id", "left").join(per, "item_id", "left").join(met, "item_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    negative = F.col("positive").isNull()
    again = F.when(~negative, F.coalesce("again", F.lit(False)))
    out = written(out.select("item_id", "source_type", negative.alias("negative"), zero("returned"), zero("false_positives"), F.when(~negative, F.col("first_right")).alias("first_right"), F.coalesce("anchor", F.lit(False)).alias("anchor"), again.alias("again")), "outcomes")
    discard(expected, hits)
    return out


def failure(o: str = "") -> Column:
    """What is wrong with an outcome, null where nothing is."""
    c = lambda n: F.col(f"{o}{n}")
    return (
        F.when(c("negative"), F.when(c("returned") > 0, "false_positive")).when(c("returned") == 0, "no_results").when(c("first_right").isNull(), "wrong_source")
        .when(c("first_right") > 1, "wrong_source_at_rank_1").when(~c("anchor"), "wrong_anchor")
    )


def ratio(a: Column, b: Column) -> Column:
    return F.round(a / F.nullif(b.cast("double"), F.lit(0.0)), 6)


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: of `results`. Ratios are null where their denominator is 0."""
    positive, hit = ~F.col("negative"), F.col("first_right").isNotNull()
    n, found = F.count_if(positive), F.count_if(hit)
    return rows.groupBy(*by).agg(
        F.count("*").alias("queries"), n.alias("positive_queries"), ratio(F.count_if(F.col("first_right") == 1), n).alias("recall_at_1"), ratio(found, n).alias("recall_at_5"),
        ratio(F.sum(F.coalesce(1 / F.col("first_right"), F.lit(0.0))), n).alias("mrr"), ratio(F.count_if(F.col("anchor") & positive), found).alias("anchor_precision"), ratio(F.sum("false_positives"), F.sum("returned")).alias("false_positive_rate"),
        ratio(F.count_if(F.col("again")), F.count("again")).alias("reformulation_success"), ratio(F.count_if(F.col("negative") & (F.col("returned") == 0)), F.count_if("negative")).alias("negative_no_result_rate"),
    )


def failures(rows: DataFrame) -> DataFrame:
    return rows.select("source_type", failure().alias("failure")).where("failure is not null").groupBy("source_type", "failure").agg(F.count("*").alias("n"))


def ablation(index: TextIndex, store: VectorStore, artifacts: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP passages of each positive item by three modes: `lexical` (BM25 over half of its words or more), `semantic` (cosine with its vector),
    `hybrid` (reciprocal ranks of the CANDIDATES best of both). Anchors count by candidate here: those right among passages of right artifacts."""
    expected = written(expected_anchors(index, artifacts, items), "expected")
    asked = items.join(expected.select("item_id").distinct(), "item_id", "left_semi")
    w = F.array_distinct(T.tokenize_fts(F.col("text")))
    lexical = index.ranked(asked.select(F.col("item_id").alias("query_id"), w.alias("tokens"), F.ceil(F.size(w) / 2).cast("int").alias("need")), CANDIDATES).select("query_id", "passage_id", "rank")
    vectors = store.current(index.passages().where("enabled").select("passage_id", "passage_text")).select(F.col("passage_id").alias("vec_id"), "embedding")
    queries = embedded(asked.select(F.col("item_id").alias("query_id"), "text"), "text", "q").select("query_id", "q")
    near = semantic.vector_topk(vectors, queries, CANDIDATES).where("similarity is not null").select("query_id", F.col("vec_id").alias("passage_id"), "rank")
    lexical, near = written(lexical, "lexical"), written(near, "semantic")
    both = lexical.select("query_id", "passage_id", F.col("rank").alias("a")).join(near.select("query_id", "passage_id", F.col("rank").alias("b")), ["query_id", "passage_id"], "full_outer")
    score = semantic.W_LEXICAL * semantic.reciprocal(F.col("a")) + semantic.W_SEMANTIC * semantic.reciprocal(F.col("b"))
    fused = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(score, 12).desc(), "passage_id")).cast("long"))
    modes = [(m, t.select(F.lit(m).alias("mode"), "query_id", "passage_id", "rank")) for m, t in (("lexical", lexical), ("semantic", near), ("hybrid", fused))]
    rows = modes[0][1].union(modes[1][1]).union(modes[2][1]).where(F.col("rank") <= TOP)
    rows = rows.join(index.passages().select("passage_id", "artifact_id", "char_start", "char_end"), "passage_id").withColumnRenamed("query_id", "item_id")
    wanted = expected.crossJoin(F.broadcast(asked.sparkSession.createDataFrame([(m,) for m, _ in modes], "mode string")))  # three rows
    keys = ["mode", "item_id", "artifact_id"]
    met = anchors_met(wanted, rows.select(*keys, *text_anchor(F.col("char_start"), F.col("char_end"))), keys).select(*keys, F.col("have.first").alias("char_start")).distinct().withColumn("met", F.lit(True))
    rows = rows.join(expected.select("item_id", "artifact_id", F.lit(True).alias("right")), ["item_id", "artifact_id"], "left").join(met, [*keys, "char_start"], "left")
    n = asked.agg(F.count("*").alias("queries"))
    per = rows.groupBy("mode", "item_id").agg(F.count("*").alias("returned"), F.count("right").alias("candidates"), F.count("met").alias("met"), F.bool_or((F.col("rank") == 1) & F.col("right")).alias("first"))
    total = per.groupBy("mode").agg(F.count_if("first").alias("first"), F.count_if(F.col("candidates") > 0).alias("found"), F.sum("candidates").alias("candidates"), F.sum("met").alias("met"), F.sum("returned").alias("returned")).crossJoin(F.broadcast(n))  # one row
    out = written(total.select("mode", "queries", ratio(F.col("first"), F.col("queries")).alias("recall_at_1"), ratio(F.col("found"), F.col("queries")).alias("recall_at_5"), ratio(F.col("met"), F.col("candidates")).alias("anchor_precision"), ratio(F.col("returned") - F.col("candidates"), F.col("returned")).alias("false_positive_rate")), "ablation")
    discard(expected, lexical, near)
    return out


def gate(measured: DataFrame, least: dict[str, float], epsilon: float = 1e-12) -> DataFrame:
    """Each metric against its threshold; a missing value fails."""
    return measured.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(v).alias("threshold")) for k, v in least.items()))).alias("m")).select("m.*", F.coalesce(F.col("m.value") + epsilon >= F.col("m.threshold"), F.lit(False)).alias("passed"))


def nearest_rank(rows: DataFrame, by: str, value: str, quantile: float) -> DataFrame:
    """Median and the value at rank ceil(q * n), by counts of distinct values: nothing is collected into a list.

    A group's distinct values meet in one task; the window holds running counts only."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy("v")
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    low, high = at(F.floor((F.col("n") + 1) / 2)), at(F.floor((F.col("n") + 2) / 2))
    return run.groupBy(by).agg(F.max("n").alias("n"), F.round((low + high) / 2, 6).alias("median"), F.round(at(F.ceil(F.lit(quantile) * F.col("n"))), 6).alias("p95"))


def _sql_base() -> str:
    """WITH clauses up to o (one row an item) of the same evaluation."""
    idf = "greatest(CASE WHEN ln((n_all - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n_all - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) END, 0)"
    return f"""WITH RECURSIVE {C.SQL_PASSAGES},
tk AS (SELECT passage_id, artifact_id, enabled, char_start, char_end, {C.sql_tokens("passage_text")} AS w FROM passages),
st AS (SELECT count(*)::DOUBLE AS n_all, avg(len(w))::DOUBLE AS average FROM tk),
it AS (SELECT item_id, regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g') AS text, CASE WHEN length(text) % 2 = 0 THEN 'long_form' ELSE 'short_form' END AS source_type FROM benchmark),
iw AS (SELECT *, list_distinct({C.sql_tokens("text")}) AS w FROM it),
ik AS (SELECT item_id, list_transform(list_sort(list_transform(w, lambda x: {{'n': -length(x), 'x': x}}))[1:{KEYWORDS}], lambda s: s.x) AS w FROM iw),
q AS (SELECT 'main' AS query, item_id, w, len(w) AS need FROM iw UNION ALL SELECT 'again', item_id, w, ceil(len(w) / 2.0)::INTEGER FROM ik UNION ALL SELECT 'half', item_id, w, ceil(len(w) / 2.0)::INTEGER FROM iw),
qt AS (SELECT query, item_id, need, unnest(w) AS term FROM q),
tf AS (SELECT passage_id, term, count(*)::DOUBLE AS f FROM (SELECT passage_id, unnest(w) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
fq AS (SELECT term, count(*)::DOUBLE AS d FROM tf GROUP BY term),
sc AS (SELECT query, item_id, need, artifact_id, passage_id, round(sum({idf} * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / average))), 9) AS s, count(*) AS m FROM qt JOIN tf USING (term) JOIN fq USING (term) JOIN tk USING (passage_id), st WHERE enabled GROUP BY ALL),
ok AS (SELECT * FROM sc WHERE m >= need),
ba AS (SELECT query, item_id, artifact_id, s, passage_id FROM (SELECT *, row_number() OVER (PARTITION BY query, item_id, artifact_id ORDER BY s DESC, passage_id) AS r FROM ok WHERE query <> 'half') WHERE r = 1),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, item_id ORDER BY s DESC, artifact_id) AS rank FROM ba) WHERE rank <= {TOP}),
ex AS (SELECT item_id, artifact_id, instr(a.text, it.text) - 1 AS first, instr(a.text, it.text) - 1 + length(it.text) AS last FROM it JOIN artifacts a ON contains(a.text, it.text) WHERE enabled),
j AS (SELECT h.*, ex.first IS NOT NULL AS good, ex.first IS NOT NULL AND char_start <= ex.first AND char_end >= ex.last AS met FROM h JOIN (SELECT passage_id, char_start, char_end FROM tk) USING (passage_id) LEFT JOIN ex USING (item_id, artifact_id)),
o AS (SELECT item_id, source_type, item_id NOT IN (SELECT item_id FROM ex) AS negative, count(*) FILTER (query = 'main') AS returned, count(*) FILTER (query = 'main' AND NOT good) AS fp, min(rank) FILTER (query = 'main' AND good) AS fr,
  coalesce(bool_or(query = 'main' AND met), false) AS anchor, coalesce(bool_or(query = 'again' AND good), false) AS again FROM it LEFT JOIN j USING (item_id) GROUP BY ALL),
f AS (SELECT *, CASE WHEN negative THEN CASE WHEN returned > 0 THEN 'false_positive' END WHEN returned = 0 THEN 'no_results' WHEN fr IS NULL THEN 'wrong_source' WHEN fr > 1 THEN 'wrong_source_at_rank_1' WHEN NOT anchor THEN 'wrong_anchor' END AS failure FROM o)"""


def sql() -> dict[str, str]:
    base = _sql_base()
    part = lambda a, b: f"round(({a})::DOUBLE / nullif({b}, 0), 6)"
    n = "count(*) FILTER (NOT negative)"
    m = f"""count(*) AS queries, {n} AS positive_queries, {part("count(*) FILTER (fr = 1)", n)} AS recall_at_1, {part("count(fr)", n)} AS recall_at_5, {part("sum(coalesce(1.0::DOUBLE / fr, 0))", n)} AS mrr, {part("count(*) FILTER (anchor AND NOT negative)", "count(fr)")} AS anchor_precision,
  {part("sum(fp)", "sum(returned)")} AS false_positive_rate, {part("count(*) FILTER (again AND NOT negative)", n)} AS reformulation_success, {part("count(*) FILTER (negative AND returned = 0)", "count(*) FILTER (negative)")} AS negative_no_result_rate"""
    gate = " UNION ALL ".join(f"SELECT '{k}' AS metric, {k} AS value, 0.1::DOUBLE AS threshold, coalesce({k} + 1e-12 >= 0.1, false) AS passed FROM m" for k in ("recall_at_1", "recall_at_5", "mrr"))
    return {
        "eval_metrics": f"{base} SELECT {m} FROM f",
        "eval_by_class": f"{base} SELECT source_type, {m} FROM f GROUP BY source_type",
        "failure_taxonomy": f"{base} SELECT source_type, failure, count(*) AS n FROM f WHERE failure IS NOT NULL GROUP BY ALL",
        "threshold_gate": f"{base}, m AS (SELECT {m} FROM f) {gate}",
    }


def ablation_sql(features) -> str:
    """features: makes the clause fb (key, bucket, value) of the hashed vectors of a table."""
    unit = lambda t, k: f"(SELECT {k}, bucket, (value / sqrt(sum(value * value) OVER (PARTITION BY {k})))::FLOAT::DOUBLE AS value FROM {t} WHERE value <> 0)"
    passages, items = features("(SELECT * FROM passages WHERE enabled)", "passage_id", "passage_text"), features("it", "item_id", "text")
    items = items.replace("ft AS", "ft2 AS").replace("FROM ft", "FROM ft2").replace("fe AS", "fe2 AS").replace("FROM fe ", "FROM fe2 ").replace("fb AS", "fb2 AS")
    part = lambda a, b: f"round(({a})::DOUBLE / nullif({b}, 0), 6)"
    return f"""{_sql_base()}, {passages}, {items},
pu AS {unit("fb", "passage_id")}, iu AS {unit("fb2", "item_id")},
pn AS (SELECT passage_id, sqrt(sum(value * value)) AS n FROM pu GROUP BY 1), im AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM iu GROUP BY 1),
di AS (SELECT item_id, passage_id, sum(a.value * b.value) AS d FROM iu a JOIN pu b USING (bucket) GROUP BY ALL),
se AS (SELECT item_id, passage_id, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(d, 0) / im.n / pn.n, 9) DESC, passage_id) AS rank FROM im CROSS JOIN pn LEFT JOIN di USING (item_id, passage_id)),
pos AS (SELECT DISTINCT item_id FROM ex),
lx AS (SELECT item_id, passage_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, passage_id) AS rank FROM ok WHERE query = 'half' AND item_id IN (FROM pos)),
ls AS (SELECT * FROM lx WHERE rank <= {CANDIDATES}), ss AS (SELECT * FROM se WHERE rank <= {CANDIDATES} AND item_id IN (FROM pos)),
hy AS (SELECT item_id, passage_id, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(0.45::DOUBLE / (60 + a.rank), 0) + coalesce(0.35::DOUBLE / (60 + b.rank), 0), 12) DESC, passage_id) AS rank FROM ls a FULL OUTER JOIN ss b USING (item_id, passage_id)),
al AS (SELECT 'lexical' AS mode, * FROM ls UNION ALL SELECT 'semantic', * FROM ss UNION ALL SELECT 'hybrid', * FROM hy),
jd AS (SELECT mode, item_id, rank, ex.first IS NOT NULL AS good, ex.first IS NOT NULL AND char_start <= ex.first AND char_end >= ex.last AS met FROM al JOIN tk USING (passage_id) LEFT JOIN ex USING (item_id, artifact_id) WHERE rank <= {TOP}),
pq AS (SELECT mode, item_id, count(*) AS returned, count(*) FILTER (good) AS c, count(*) FILTER (met) AS met, bool_or(rank = 1 AND good) AS one FROM jd GROUP BY ALL)
SELECT mode, (SELECT count(*) FROM pos) AS queries, {part("count(*) FILTER (one)", "(SELECT count(*) FROM pos)")} AS recall_at_1, {part("count(*) FILTER (c > 0)", "(SELECT count(*) FROM pos)")} AS recall_at_5, {part("sum(met)", "sum(c)")} AS anchor_precision, {part("sum(returned) - sum(c)", "sum(returned)")} AS false_positive_rate FROM pq GROUP BY mode"""
