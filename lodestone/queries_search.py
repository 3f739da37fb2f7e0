"""Registered queries on passages, full-text search, vocabulary and evidence, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import lexical
from lodestone.operators.segments import BLOCK, TextIndex
from lodestone.plans import canonical as C
from lodestone.plans import stored
from lodestone.plans.query import parse_query, phrase_terms
from lodestone.plans.storage import shared_dir

#: A word, a phrase, two phrases, and a filtered query over the words of the driver's invented English.
WORD, PHRASE, TWO, FILTERED = "the", '"of the"', 'the "and the" of', 'the type:markdown path:src1 after:2024-01-10 before:2025-06-01 confidence:>=0.9'
HIT_COLUMNS = ("rank", "passage_id", "artifact_id", "title", "source_uri")


def _search(query: str, limit: int = 20):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = stored.text_index(spark, sf_dir).search(query, limit)
        return hits.select(*HIT_COLUMNS, F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))

    return run


def _sql_hits(query: str, limit: int) -> str:
    """WITH clauses up to `hits` (ranked, with tokens) for a query; filters are given as SQL."""
    parsed = parse_query(query)
    phrases = [phrase_terms(p) for p in parsed.phrases]
    count = lambda t: f"len(list_filter(range(1, len(toks) - {len(t) - 2}), lambda i: " + " AND ".join(f"toks[i + {k}] = '{w}'" for k, w in enumerate(t)) + "))"
    f, conditions = parsed.filters, ["enabled", *(f"f{i} > 0" for i in range(len(phrases)))]
    if f.after_ns is not None:
        conditions.append(f"mtime_ns >= {f.after_ns}")
    if f.before_ns is not None:
        conditions.append(f"mtime_ns < {f.before_ns}")
    if f.source_type == "markdown":
        conditions.append("media_type = 'text/markdown'")
    if f.path:
        conditions.append(f"contains(lower(source_uri), '{f.path.lower()}')")
    idf = lambda i: f"(SELECT greatest(CASE WHEN ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) END, 0) FROM st)"
    weight = lambda i: f"f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks) / (SELECT a FROM st)))"
    score = " + ".join(f"{idf(i)} * {weight(i)}" for i in range(len(phrases)))
    return f"""WITH RECURSIVE {C.SQL_PASSAGES},
tk AS (SELECT *, {C.sql_tokens("passage_text")} AS toks FROM passages),
fr AS (SELECT *, {", ".join(f"{count(t)} AS f{i}" for i, t in enumerate(phrases))} FROM tk),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(toks))::DOUBLE AS a, {", ".join(f"(count(*) FILTER (f{i} > 0))::DOUBLE AS d{i}" for i in range(len(phrases)))} FROM fr),
sc AS (SELECT *, -({score}) AS bm25 FROM fr WHERE {" AND ".join(conditions)}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY bm25, title, artifact_id, rowid) AS rank FROM sc) WHERE rank <= {limit})"""


def _search_sql(query: str, limit: int = 20) -> str:
    return f"{_sql_hits(query, limit)} SELECT {', '.join(HIT_COLUMNS)}, round(bm25, 6) AS bm25, round(1 / (1 + abs(bm25)), 6) AS score FROM hits"


def passage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.passages(spark, sf_dir)
    return p.select("passage_id", "artifact_id", "ordinal", "char_start", "char_end", F.concat(F.lit("sha256:"), F.sha2("passage_text", 256)).alias("text_hash"))


def passage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.passages(spark, sf_dir).select("passage_id", F.col("passage_line").alias("line_start"), F.col("passage_last_line").alias("line_end"))


def active_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that 64 bits cannot hold are null; they are whole where they are compared."""
    return C.active(C.passages(spark, sf_dir)).select("passage_id", "title", "media_type", "source_uri", F.col("mtime_ns").try_cast("long").alias("mtime_ns"), "content_hash")


def lexical_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase query after changes: an index of all passages but those of src1's artifacts and with src2's in an older form, to which
    src1's are added, src2's are put right, and whose segments are merged."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    p = C.passages(spark, sf_dir).drop("text")
    old = F.when(F.col("root") == "src2", F.concat(F.lit("of the old form of the "), "passage_text")).otherwise(F.col("passage_text"))
    index = TextIndex(spark, path).upsert(p.where("root <> 'src1'").withColumn("passage_text", old))
    hits = index.upsert(p.where("root = 'src1'")).upsert(p.where("root = 'src2'")).merge(keep=1).search(PHRASE)
    return hits.select(*HIT_COLUMNS, F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index holds, counted from its blocks: passages with tokens, postings, occurrences, the largest block's passages."""
    blocks = stored.text_index(spark, sf_dir).blocks()
    per = blocks.select(F.size("slots").alias("n"), "most", F.array_max("counts").alias("top"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("cnt"))
    return per.agg(F.sum("n").alias("postings"), F.sum("cnt").alias("occurrences"), F.count_if(F.col("most") != F.col("top")).alias("wrong_bounds"), (F.max("n") <= BLOCK).alias("bounded"))


def lexical_highlight_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.evidence(stored.text_index(spark, sf_dir).search(TWO, 10))
    marked = F.array_join(F.transform("segments", lambda s: F.when(s["highlighted"], F.concat(F.lit("["), s["text"], F.lit("]"))).otherwise(s["text"])), "")
    return hits.select("rank", "passage_id", "match_start", "match_end", "line_start", "line_end", marked.alias("marked"))


def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stored.text_index(spark, sf_dir).passages().select("passage_id", F.col("tokens").alias("t"))
    return p.select("passage_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


def fts_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.text_index(spark, sf_dir).vocabulary()


def fts_vocab_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stored.text_index(spark, sf_dir).passages()
    return p.select("rowid", F.posexplode("tokens").alias("offset", "term")).select("term", "rowid", F.col("offset").cast("long").alias("offset"))


QUERIES = {
    "lexical_search": _search(WORD), "lexical_phrase": _search(PHRASE), "lexical_two_phrases": _search(TWO), "lexical_filtered": _search(FILTERED), "lexical_postings": lexical_postings, "index_segments": index_segments,
    "lexical_highlight_anchor": lexical_highlight_anchor, "fts_tokens": fts_tokens, "fts_vocab": fts_vocab, "fts_vocab_instance": fts_vocab_instance, 
    "passage_split": passage_split, "passage_lines": passage_lines, "active_passages": active_passages,
}

_P = f"WITH RECURSIVE {C.SQL_PASSAGES}"
_TK = f"{_P}, tk AS (SELECT *, {C.sql_tokens('passage_text')} AS toks FROM passages)"


def _highlight_sql() -> str:
    phrases = [phrase_terms(p) for p in parse_query(TWO).phrases]
    spans = " || ".join(f"list_transform(list_filter(range(1, len(toks) - {len(t) - 2}), lambda i: " + " AND ".join(f"toks[i + {k}] = '{w}'" for k, w in enumerate(t)) + f"), lambda i: {{'a': i, 'b': i + {len(t)}}})" for t in phrases)
    folded = f"translate(lower(passage_text), '{T.ACCENTED}', '{T.PLAIN}')"
    # token spans; islands of overlapping ones; character offsets of tokens from the lengths of words and gaps
    return f"""{_sql_hits(TWO, 10)},
sp AS (SELECT DISTINCT rank, s.a AS a, s.b AS b FROM (SELECT rank, unnest({spans}) AS s FROM hits)),
mk AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY rank ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sp),
isl AS (SELECT rank, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY rank ORDER BY a, b) AS g FROM mk) GROUP BY rank, g),
wd AS (SELECT rank, regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}]+') AS ws, regexp_extract_all({folded}, '[^\\p{{L}}\\p{{N}}]+') AS gs, regexp_matches({folded}, '^[\\p{{L}}\\p{{N}}]') AS starts FROM hits),
off AS (SELECT rank, i, list_sum(list_transform(ws[1:i - 1], lambda x: length(x))) AS w, list_sum(list_transform(gs[1:CASE WHEN starts THEN i - 1 ELSE i END], lambda x: length(x))) AS g, length(ws[i]) AS l FROM wd, unnest(range(1, len(ws) + 1)) AS t(i)),
oc AS (SELECT rank, i, (coalesce(w, 0) + coalesce(g, 0))::BIGINT AS p0, (coalesce(w, 0) + coalesce(g, 0) + l)::BIGINT AS p1 FROM off),
rg AS (SELECT isl.rank, x.p0, y.p1 FROM isl JOIN oc x ON x.rank = isl.rank AND x.i = isl.a JOIN oc y ON y.rank = isl.rank AND y.i = isl.b - 1),
pc AS (SELECT rg.rank, p0, substr(passage_text, coalesce(lag(p1) OVER (PARTITION BY rg.rank ORDER BY p0), 0) + 1, p0 - coalesce(lag(p1) OVER (PARTITION BY rg.rank ORDER BY p0), 0)) || '[' || substr(passage_text, p0 + 1, p1 - p0) || ']' AS piece FROM rg JOIN hits USING (rank)),
tx AS (SELECT rank, string_agg(piece, '' ORDER BY p0) AS body FROM pc GROUP BY rank),
bd AS (SELECT rank, min(p0) AS a, max(p1) AS z FROM rg GROUP BY rank)
SELECT h.rank, h.passage_id, h.char_start + a AS match_start, h.char_start + z AS match_end,
  (1 + length(substr(text, 1, h.char_start + a)) - length(replace(substr(text, 1, h.char_start + a), chr(10), '')))::INTEGER AS line_start,
  (1 + length(substr(text, 1, h.char_start + z - 1)) - length(replace(substr(text, 1, h.char_start + z - 1), chr(10), '')))::INTEGER AS line_end,
  body || substr(passage_text, z + 1) AS marked
FROM hits h JOIN tx USING (rank) JOIN bd USING (rank)"""


ORACLES = {
    "lexical_search": _search_sql(WORD), "lexical_phrase": _search_sql(PHRASE), "lexical_two_phrases": _search_sql(TWO), "lexical_filtered": _search_sql(FILTERED), "lexical_postings": _search_sql(PHRASE),
    "lexical_highlight_anchor": _highlight_sql(),
    "fts_tokens": f"{_TK} SELECT passage_id, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_distinct, sha256(array_to_string(toks, ' ')) AS digest FROM tk",
    "fts_vocab": f"{_TK} SELECT term, count(DISTINCT rowid) AS doc, count(*) AS cnt FROM (SELECT rowid, unnest(toks) AS term FROM tk) GROUP BY term",
    "fts_vocab_instance": f"{_TK} SELECT toks[i] AS term, rowid, i - 1 AS \"offset\" FROM tk, unnest(range(1, len(toks) + 1)) AS t(i)",
    "index_segments": f"{_TK}, po AS (SELECT rowid, term, count(*) AS n FROM (SELECT rowid, unnest(toks) AS term FROM tk) GROUP BY ALL) SELECT count(*) AS postings, sum(n)::BIGINT AS occurrences, 0::BIGINT AS wrong_bounds, true AS bounded FROM po",
    "passage_split": f"{_P} SELECT passage_id, artifact_id, ordinal, char_start, char_end, 'sha256:' || sha256(passage_text) AS text_hash FROM passages",
    "passage_lines": f"{_P}, l AS (SELECT passage_id, 1 + length(substr(text, 1, char_start)) - length(replace(substr(text, 1, char_start), chr(10), '')) AS line_start, length(passage_text) - length(replace(passage_text, chr(10), '')) AS inside FROM passages) SELECT passage_id, line_start::BIGINT AS line_start, (line_start + inside)::BIGINT AS line_end FROM l",
    "active_passages": f"{_P} SELECT passage_id, title, media_type, source_uri, mtime_ns, content_hash FROM passages WHERE enabled",
}
