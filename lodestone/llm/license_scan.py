"""License scans: exact set-similarity join (DataFrame functions only).

Every text block (a line, or a window of words) is compared with license templates by containment: the part of the
template's distinct words that the block holds. Tokens are ordered by their frequency over all
blocks, rarest first; words of no template stand before all others, as no template can share them. If a block holds at
least `need` of a template's m tokens, it must hold one of the template's first m - need + 1 (prefix filter), it must have at
least `need` distinct words (length filter), and with its first shared token at place p of the template and q of the block, at
most 1 + min(m - p - 1, tokens of the block after q) tokens are shared (positional filter). Candidates that pass are verified
on the full word sets, so the join is exact: every block at or above the threshold is found.

A notice may be wrapped, so runs of words across line ends are blocks too: windows with as many words as the
template. A document that holds a prefix token and `need` tokens of a template has its windows verified
where it is, from each template word on (no other start is better): only the best containment leaves the row.

The texts are read twice: to count template tokens (one row a token), and to write, per document,
its counts and the blocks that hold a prefix token. No text is shuffled: what is joined with the
prefix index are the tokens of those blocks, and matches go back to the narrow document rows.

Base labels are exact phrases. Words are runs of characters other than ASCII ones that are neither
letters nor digits, after lower-casing A-Z alone.

Defined results: a null text is empty; no words give n_words 0, no labels and score 0.0; equal rows
are scanned one by one; extra columns stay out; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrase and label of the base rules.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label and text of each template: the usual notices of public licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
)
#: Least containment of a template in a block.
THRESHOLD = 0.9


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a lowered text, in order."""
    return F.filter(F.split(text, NON_WORD), lambda w: w != "")


def _template_sets(templates) -> list[tuple[str, list[str]]]:
    """Label and distinct words of each template, on the driver: templates are a parameter, not data."""
    out = []
    for label, text in templates:
        low = text.translate(str.maketrans(UPPER, LOWER))
        if found := list(dict.fromkeys(w for w in re.split(NON_WORD, low) if w)):
            out.append((label, found))
    return out


def needed(size: int, threshold: float) -> int:
    """Fewest shared tokens that reach the threshold."""
    return next(k for k in range(size + 1) if k >= threshold * size - 1e-9)


def frequency_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The template tokens by their number of places in the corpus, rarest first (ties by token).

    One row for each template token reaches the driver."""
    token = docs.select(F.explode(F.split(lowered(docs[text_col]), NON_WORD)).alias("token"))
    seen = {r["token"]: r["count"] for r in token.where(F.col("token").isin(vocabulary)).groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def prefix_index(templates, order: list[str], threshold: float) -> list[tuple]:
    """token, template number, place in the ordered template, its size, the tokens needed and the token's rank; prefixes only."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, (_, tokens) in enumerate(_template_sets(templates)):
        tokens = sorted(tokens, key=rank.__getitem__)
        need = needed(len(tokens), threshold)
        rows += [(w, number, p, len(tokens), need, rank[w]) for p, w in enumerate(tokens[: len(tokens) - need + 1])]
    return rows


def candidates(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """blocks: row, block, held (distinct words), ranks (of its template words). index: rows of `prefix_index`.
    Pairs of a block and a template that share a prefix token and pass the length filter, and whether they pass the
    positional one."""
    hits = blocks.select("row", "block", "held", "ranks", F.explode("held").alias("token")).join(index, "token").where(F.size("held") >= F.col("need"))
    pairs = hits.groupBy("row", "block", "template", "template_size", "need").agg(F.min(F.struct("position", "rank")).alias("first"), F.first("held").alias("held"), F.first("ranks").alias("ranks"))
    left = F.least(F.col("template_size") - F.col("first.position") - 1, F.size(F.filter("ranks", lambda r: r > F.col("first.rank"))))
    return pairs.withColumn("passes", 1 + left >= F.col("need"))


def _word_counts(templates) -> list[int]:
    """The number of words, repeated ones too, of each template of `_template_sets`."""
    low = [text.translate(str.maketrans(UPPER, LOWER)) for _, text in templates]
    return [n for n in (len([w for w in re.split(NON_WORD, t) if w]) for t in low) if n]


def _windows(ws: Column, distinct: Column, tokens: list[str], prefix: list[str], width: int, need: int) -> Column:
    """Most tokens of a template that `width` words in a row hold; null if fewer than needed."""
    own = F.array(*(F.lit(w) for w in tokens))
    starts = F.filter(F.sequence(F.lit(1), F.size(ws)), lambda i: F.array_contains(own, F.element_at(ws, i)))
    held = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(ws, i, width), own))))
    maybe = F.arrays_overlap(distinct, F.array(*(F.lit(w) for w in prefix))) & (F.size(F.array_intersect(distinct, own)) >= need)
    return F.when(maybe, F.when(held >= need, held))


def _phrase_starts(ws: Column, phrase: str) -> Column:
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        found = F.get(ws, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            found = found & (F.get(ws, i + k) == w)
        return found

    return F.filter(F.sequence(F.lit(0), F.size(ws) - len(parts)), here)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (best containment at or above the threshold, else 0) and matches (array of label and containment)."""
    spark = docs.sparkSession
    sets = _template_sets(templates)
    order = frequency_order(docs, text_col, sorted({w for _, tokens in sets for w in tokens}))
    rows = prefix_index(templates, order, threshold)
    prefix_words = sorted({w for w, *_ in rows})

    # one pass over the texts leaves, per document, its counts and the blocks that hold a prefix token
    def holds(text: Column, found: list[str]) -> Column:
        out = F.lit(False)
        for w in found:
            out = out | F.contains(text, F.lit(w))
        return out

    # substrings are only a quick first look; a block stays if a whole word of it is a prefix token
    prefixes = F.array(*(F.lit(w) for w in prefix_words))
    lines = F.filter(F.split("low", "\n"), lambda x: holds(x, prefix_words))
    held = F.filter(F.transform(lines, lambda x: F.array_distinct(words(x))), lambda x: F.arrays_overlap(x, prefixes))
    held = F.when(F.arrays_overlap("ws", prefixes), held).otherwise(F.array().cast("array<array<string>>"))
    base = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), lowered(docs[text_col]).alias("low"))
    base = base.withColumn("ws", words(F.col("low")))
    base = base.withColumn("distinct_ws", F.when(holds(F.col("low"), prefix_words), F.array_distinct("ws")).otherwise(F.array().cast("array<string>")))
    wrapped = F.array(*(
        F.struct(F.lit(label).alias("label"), (_windows(F.col("ws"), F.col("distinct_ws"), tokens, [w for w, k, *_ in rows if k == n], width, needed(len(tokens), threshold)) / F.lit(len(tokens))).alias("containment"))
        for n, ((label, tokens), width) in enumerate(zip(sets, _word_counts(templates), strict=True))
    ))
    wrapped = F.filter(wrapped, lambda m: m["containment"].isNotNull())
    for k, (phrase, _) in enumerate(phrases):
        parts = phrase.split(" ")
        maybe = holds(F.col("low"), [max(parts, key=len)]) & (F.size("ws") >= len(parts))
        base = base.withColumn(f"starts_{k}", F.when(maybe, _phrase_starts(F.col("ws"), phrase)).otherwise(F.array().cast("array<int>")))
    base = common.staged(
        base.select("row", "doc_id", F.size("ws").cast("long").alias("n_words"), *(f"starts_{k}" for k in range(len(phrases))), held.alias("blocks"), wrapped.alias("wrapped")),
        "license-blocks",
    )
    index = spark.createDataFrame(rows, "token string, template int, position int, template_size int, need int, rank int")
    full = spark.createDataFrame([(n, label, tokens) for n, (label, tokens) in enumerate(sets)], "template int, label string, template_tokens array<string>")
    blocks = base.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "held"))
    vocabulary = F.create_map(*(F.lit(x) for pair in zip(order, range(len(order)), strict=True) for x in pair))
    blocks = blocks.withColumn("ranks", F.filter(F.transform("held", lambda w: F.try_element_at(vocabulary, w)), lambda r: r.isNotNull()))
    pairs = candidates(blocks, index).where("passes").select("row", "block", "held", "template", "template_size", "need").join(full, "template")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("held", "template_tokens"))).where("shared >= need")
    pairs = pairs.select("row", "label", (F.col("shared") / F.col("template_size")).alias("containment"))
    found = pairs.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("label", "containment"))).alias("matches"))
    out = base.drop("blocks").join(found, "row", "left")
    # a match of a line stays as it is; one of a window is listed beside it if it is another
    both = F.sort_array(F.array_union(F.coalesce("matches", F.array().cast(found.schema["matches"].dataType)), "wrapped"))
    out = out.withColumn("matches", F.when(F.size(both) > 0, both))
    starts = [F.col(f"starts_{k}") for k in range(len(phrases))]
    base_labels = F.filter(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(starts, phrases, strict=True))), lambda x: x.isNotNull())
    named = F.coalesce(F.transform("matches", lambda m: m["label"]), F.array().cast("array<string>"))
    places = F.concat(*starts)
    return out.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, named)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
        "matches",
    )


def op9_set_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("matches")


def _oracle() -> str:
    """DuckDB: every line and every window of words against every template by full word sets; phrases by position."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sets = zip(_template_sets(TEMPLATES), _word_counts(TEMPLATES), strict=True)
    templates = ", ".join(f"({quoted(label)}, [{', '.join(map(quoted, tokens))}], {needed(len(tokens), THRESHOLD)}, {width})" for (label, tokens), width in sets)
    phrases = ", ".join(f"({quoted(label)}, {quoted(phrase)}, {len(phrase.split())})" for phrase, label in PHRASES)
    split = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH t(label, tokens, need, width) AS (VALUES {templates}), p(label, phrase, len) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT rid, doc_id, low, {split.format("low")} AS ws FROM d),
s AS (SELECT rid, p.label, i FROM w, p, unnest(range(1, len(ws) - p.len + 2)) AS u(i) WHERE contains(low, split_part(phrase, ' ', 1)) AND array_to_string(list_slice(ws, i, i + p.len - 1), ' ') = phrase),
b AS (SELECT rid, list_distinct({split.format("line")}) AS held FROM (SELECT rid, unnest(string_split(low, chr(10))) AS line FROM d)),
c AS (SELECT rid, ws, label, tokens, need, width FROM w, t WHERE len(list_intersect(list_distinct(ws), tokens)) >= need),
x AS (SELECT rid, label, tokens, need, list_distinct(list_slice(ws, i, i + width - 1)) AS held FROM c, unnest(range(1, len(ws) + 1)) AS u(i) WHERE list_contains(tokens, ws[i])),
m AS (SELECT rid, label, len(list_intersect(held, tokens)) / len(tokens) AS containment FROM b, t WHERE len(list_intersect(held, tokens)) >= need
  UNION ALL SELECT rid, label, len(list_intersect(held, tokens)) / len(tokens) FROM x WHERE len(list_intersect(held, tokens)) >= need),
l AS (SELECT rid, label FROM s UNION SELECT rid, label FROM m)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(sp.n, 0)::BIGINT AS n_base, sp.a::BIGINT AS first_word, sp.z::BIGINT AS last_word,
  coalesce(sp.labels, '') AS base_labels, coalesce(la.labels, '') AS labels, coalesce(mm.score, 0)::DOUBLE AS score
FROM w LEFT JOIN (SELECT rid, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM s GROUP BY rid) sp ON sp.rid = w.rid
LEFT JOIN (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l GROUP BY rid) la ON la.rid = w.rid
LEFT JOIN (SELECT rid, max(containment) AS score FROM m GROUP BY rid) mm ON mm.rid = w.rid"""


QUERIES = {"op9_set_similarity_join": op9_set_similarity_join}
ORACLES = {"op9_set_similarity_join": _oracle()}
