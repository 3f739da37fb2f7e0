"""Full-text search: phrases that must all occur, BM25 over all passages, filters before ranking, evidence segments.

`search` scans passages: token arrays are built, tested and counted inside one stage, and only a row of statistics is exchanged. It
needs no index and gives the same hits as `segments.TextIndex`, which the registered queries read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.query import ParsedQuery, QueryFilters, parse_query, phrase_terms

K1, B = 1.2, 0.75
MAX_LIMIT = 100
#: Best first: ties of the score go by title, artifact and row.
ORDER = ("bm25", "title", "artifact_id", "rowid")


def starts(tokens: Column, terms: list[str]) -> Column:
    """0-based token positions at which the terms stand in a row.

    The tokens are bound once: a predicate that the optimizer pushes down carries their expression along, and
    would else build them again at every position."""

    def found(t: Column) -> Column:
        hit = lambda i: reduce(lambda a, b: a & b, [F.get(t, i + k) == w for k, w in enumerate(terms)])
        held = reduce(lambda a, b: a & b, [F.array_contains(t, w) for w in dict.fromkeys(terms)])
        none = F.array().cast("array<int>")
        return F.when(held & (F.size(t) >= len(terms)), F.filter(F.sequence(F.lit(0), F.size(t) - len(terms)), hit)).otherwise(none)

    return F.element_at(F.transform(F.array(tokens), found), 1)


def filter_conditions(f: QueryFilters) -> list[Column]:
    """Conditions over mtime_ns, media_type, source_uri and confidence (1.0 where a table has none)."""
    out = []
    if f.after_ns is not None:
        out.append(F.col("mtime_ns") >= f.after_ns)
    if f.before_ns is not None:
        out.append(F.col("mtime_ns") < f.before_ns)
    if f.source_type:
        m = F.col("media_type")
        out.append({"pdf": m == "application/pdf", "image": F.startswith(m, F.lit("image/")), "text": m.isin("text/plain", "text/markdown", "text/x-bookmark"), "markdown": m == "text/markdown"}.get(f.source_type, F.lower(m) == f.source_type))
    if f.path:
        out.append(F.contains(F.lower("source_uri"), F.lit(f.path.lower())))
    if f.confidence:
        op, v = f.confidence
        c = F.col("confidence")
        out.append({">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v, "=": F.abs(c - v) <= 2.220446049250313e-16}[op])
    return out


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    """Best first: bm25 ascending, then title, artifact and row."""
    top = scored.orderBy(*ORDER).limit(max(1, min(limit, MAX_LIMIT)))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*ORDER)).cast("long")).withColumn("score", 1 / (1 + F.abs("bm25")))


def idf(n: Column, df: Column) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, 1e-6).otherwise(value)


def weight(f: Column, length: Column, average: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def _spans(starts: str, n: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("first"), (s + n).alias("last")))


def search(passages: DataFrame, query: str | ParsedQuery, limit: int = 20) -> DataFrame:
    """passages: all of them (statistics cover revoked and superseded ones), with enabled and the filter columns."""
    parsed = parse_query(query) if isinstance(query, str) else query
    phrases = [t for t in map(phrase_terms, parsed.phrases) if t]
    rows = passages.withColumn("tokens", T.tokenize_fts(F.col("passage_text")))
    for i, terms in enumerate(phrases):
        rows = rows.withColumn(f"starts_{i}", starts(F.col("tokens"), terms))
    rows = rows.withColumn("n_tokens", F.size("tokens"))
    stats = rows.agg(F.count("*").cast("double").alias("n_all"), F.avg("n_tokens").alias("average"), *(F.count_if(F.size(f"starts_{i}") > 0).cast("double").alias(f"df_{i}") for i in range(len(phrases))))
    if "confidence" not in rows.columns:
        rows = rows.withColumn("confidence", F.lit(1.0))
    hit = reduce(lambda a, b: a & b, [F.size(f"starts_{i}") > 0 for i in range(len(phrases))])
    for c in (hit, F.col("enabled"), *filter_conditions(parsed.filters)):
        rows = rows.where(c)
    rows = rows.crossJoin(F.broadcast(stats))  # one row
    score = reduce(lambda a, b: a + b, [idf(F.col("n_all"), F.col(f"df_{i}")) * weight(F.size(f"starts_{i}").cast("double"), F.col("n_tokens"), F.col("average")) for i in range(len(phrases))])
    spans = F.concat(*(_spans(f"starts_{i}", len(t)) for i, t in enumerate(phrases)))
    return _ranked(rows.withColumn("bm25", -score).withColumn("spans", spans), limit)


def merged_spans(spans: Column) -> Column:
    """Token spans in order, overlapping ones as one; spans that only touch stay apart."""
    zero = F.array().cast("array<struct<first:int,last:int>>")

    def step(found: Column, s: Column) -> Column:
        last = F.element_at(found, -1)
        joined = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))
        return F.when((F.size(found) > 0) & (s["first"] < F.try_element_at(found, F.lit(-1))["last"]), joined).otherwise(F.concat(found, F.array(s)))

    return F.aggregate(F.array_sort(F.array_distinct(spans)), zero, step)


def _offsets(text: Column) -> Column:
    """Character start and end of every full-text token of a text: array<struct<at, upto>>."""
    pieces = F.split(F.translate(F.lower(text), T.ACCENTED, T.PLAIN), r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,upto:int>>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p)
        word = p.rlike(r"^[\p{L}\p{N}]")
        return F.struct(end.alias("at"), F.when(word, F.concat(s["found"], F.array(F.struct(s["at"].alias("at"), end.alias("upto"))))).otherwise(s["found"]).alias("found"))

    return F.aggregate(pieces, zero, step, lambda s: s["found"])


def evidence(hits: DataFrame) -> DataFrame:
    """Adds, to the final hits only, segments (text, highlighted) and the anchor from the first match to the last."""
    rows = hits.withColumn("offsets", _offsets(F.col("passage_text")))
    chars = F.transform(merged_spans(F.col("spans")), lambda s: F.struct(F.get("offsets", s["first"])["at"].alias("at"), F.get("offsets", s["last"] - 1)["upto"].alias("upto")))
    rows = rows.withColumn("ranges", chars)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,highlighted:boolean>>").alias("found"))
    part = lambda a, b, lit: F.struct(F.substring("passage_text", a + 1, b - a).alias("text"), F.lit(lit).alias("highlighted"))

    def step(s: Column, r: Column) -> Column:
        before = F.when(r["at"] > s["at"], F.array(part(s["at"], r["at"], False))).otherwise(F.array().cast("array<struct<text:string,highlighted:boolean>>"))
        return F.struct(r["upto"].alias("at"), F.concat(s["found"], before, F.array(part(r["at"], r["upto"], True))).alias("found"))

    n = F.length("passage_text")
    done = lambda s: F.when(s["at"] < n, F.concat(s["found"], F.array(part(s["at"], n, False)))).otherwise(s["found"])
    rows = rows.withColumn("segments", F.aggregate("ranges", zero, step, done))
    first, last = F.col("char_start") + F.get("ranges", F.lit(0))["at"], F.col("char_start") + F.element_at("ranges", -1)["upto"]
    at, upto = first.cast("int"), (last - 1).cast("int")
    if "passage_line" in hits.columns:  # the passage's first line is known: the artifact's text is not read
        line = lambda place: T.line_of(F.col("passage_text"), place - F.col("char_start").cast("int")) + F.col("passage_line").cast("int") - 1
    else:
        line = lambda place: T.line_of(F.col("text"), place)
    return rows.withColumns({"match_start": first, "match_end": last, "line_start": line(at), "line_end": line(upto)}).drop("offsets", "ranges")
