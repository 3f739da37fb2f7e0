"""Quality rules: suffix-array repetition.

Each text is a sequence of words (maximal runs without the six ASCII white-space characters). Its
suffix array is built by prefix doubling (only suffixes that still tie are sorted again), the array
of longest common prefixes (LCP) of neighbours follows from the stored ranks, and LCP intervals of
at least `min_words` words are the maximal repeated substrings. The union of their spans gives the
covered fraction; the deepest interval is the longest repeat. A document is rejected when either
is above its limit, or by the two base rules.

The work is per document: no shuffle, no state, and blocks of bounded size inside a task.

Defined results: a null or empty text has no words, all counts 0, `base_failed` true, `kept` false.
Repeated rows are judged one by one. Extra columns pass through `filter_documents` untouched,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common

SYMBOLS = b"#*$%&|<>"
#: Base rules: fewest words, window of repeated words, percentage of them allowed.
MIN_WORDS, WINDOW, MAX_PERCENT = 20, 8, 30
#: The method's limits: a repeat counts from MIN_REPEAT words on; at most MAX_COVERED of the words
#: may lie in repeats, and no repeat may be longer than MAX_LONGEST words.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_LONGEST = 5, 25, 64

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def neighbours(doc: np.ndarray, token: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of all documents of a block, and the LCP of each suffix with the one before it.

    doc, token: document and word number of each position; end: where its document ends. Suffixes
    end with their document, and suffixes of different documents have no common prefix."""
    n = len(token)
    order = np.lexsort((token, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (token[order][1:] != token[order][:-1])]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h, ties = [rank.astype(np.int32)], 1, order[~(new & np.r_[new[1:], True])]
    while len(ties):
        after = ties + h
        inside = after < end[ties]
        second = np.full(len(ties), -1, np.int64)
        second[inside] = rank[after[inside]]
        first = rank[ties]
        if n < 3_000_000_000:
            by = np.argsort(first * (n + 1) + second + 1, kind="stable")
        else:
            by = np.lexsort((second, first))
        ties, first, second = ties[by], first[by], second[by]
        group = np.r_[True, first[1:] != first[:-1]]
        new = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(ties))
        rank = rank.copy()
        rank[ties] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank.astype(np.int32))
        ties = ties[~(new & np.r_[new[1:], True])]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    pair = np.flatnonzero(np.r_[False, doc[suffixes[1:]] == doc[suffixes[:-1]]])
    a, b = suffixes[pair - 1], suffixes[pair]
    got = np.zeros(len(pair), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        live = np.flatnonzero((x < end[a]) & (y < end[b]))
        same = live[levels[j][x[live]] == levels[j][y[live]]]
        got[same] += 1 << j
    lcp[pair] = got
    return suffixes, lcp


def longest_at(suffixes: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position the longest prefix of its suffix that also starts elsewhere: the depth of
    the deepest LCP interval that holds the suffix."""
    depth = np.zeros(len(lcp), np.int64)
    depth[suffixes] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return depth


def covered(depth: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in the union of the spans of all repeats of `least` words or more."""
    step = np.zeros(len(depth) + 1, np.int64)
    at = np.flatnonzero(depth >= least)
    np.add.at(step, at, 1)
    np.add.at(step, at + depth[at], -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of each text."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")}
    split: list[list[bytes]] = []
    for i, text in enumerate(texts):
        words = text.split() if text else []
        split.append(words)
        out["n_words"][i] = len(words)
        if words:
            joined = b"".join(words)
            out["word_chars"][i] = len(joined.decode("utf-8", "replace"))
            out["n_symbols"][i] = len(joined) - len(joined.translate(None, SYMBOLS))
            if b"\n" in text:
                lines = [x for x in text.split(b"\n") if x.strip()]
                out["n_dup_lines"][i] = len(lines) - len(set(lines))
    for lo, hi in common.blocks(out["n_words"], common.BLOCK_WORDS):
        sizes = out["n_words"][lo:hi]
        total = int(sizes.sum())
        if not total:
            continue
        token = pd.factorize(np.array([w for words in split[lo:hi] for w in words] + [None], object)[:-1])[0]
        doc = np.repeat(np.arange(hi - lo), sizes)
        end = np.repeat(np.cumsum(sizes), sizes)
        depth = longest_at(*neighbours(doc, token, end))
        for name, least in (("n_repeat_words", WINDOW), ("n_covered_words", min_repeat)):
            out[name][lo:hi] = np.bincount(doc[covered(depth, least)], minlength=hi - lo)
        longest = np.zeros(hi - lo, np.int64)
        np.maximum.at(longest, doc, depth)
        out["longest_repeat"][lo:hi] = longest
    return out


def judge(texts: list[bytes | None], min_repeat: int = MIN_REPEAT, max_covered_percent: float = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> dict[str, np.ndarray]:
    """The counts, the base verdict and the method's verdict of each text."""
    out = measure(texts, min_repeat)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["n_covered_words"] <= max_covered_percent * out["n_words"]) & (out["longest_repeat"] <= max_longest)
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: its id and COLUMNS."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(v) for k, v in judge(common.utf8_column(part.column("text")), **limits).items()})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def filter_documents(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                yield part.filter(pa.array(judge(common.utf8_column(part.column(at)), **limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents")).drop("n_covered_words", "longest_repeat")


def _windows(name: str, size: int) -> str:
    """Per document the number of words in `size`-word windows that occur twice or more in it."""
    return f"""
{name}_w AS (SELECT rid, i, array_to_string(list_slice(words, i, i + {size - 1}), ' ') AS g FROM w, unnest(range(1, n_words - {size - 2})) AS t(i) WHERE n_words >= {size}),
{name}_r AS (SELECT a.rid, a.i FROM {name}_w a JOIN (SELECT rid, g FROM {name}_w GROUP BY rid, g HAVING count(*) > 1) b ON a.rid = b.rid AND a.g = b.g),
{name} AS (SELECT rid, count(DISTINCT i + d) AS n FROM {name}_r, unnest(range(0, {size})) AS t(d) GROUP BY rid)"""


#: DuckDB: a text has a repeat longer than MAX_LONGEST words just if a window of one word more repeats.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, len(words) AS n_words FROM (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
{_windows("r8", WINDOW)}, {_windows("r5", MIN_REPEAT)}, {_windows("rx", MAX_LONGEST + 1)},
c AS (SELECT w.rid, doc_id, n_words::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
  coalesce(r8.n, 0)::BIGINT AS n_repeat_words, coalesce(r5.n, 0)::BIGINT AS n_covered, coalesce(rx.n, 0) AS n_long
  FROM w LEFT JOIN l ON w.rid = l.rid LEFT JOIN r8 ON w.rid = r8.rid LEFT JOIN r5 ON w.rid = r5.rid LEFT JOIN rx ON w.rid = rx.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_PERCENT} * n_words) AND 100 * n_covered <= {MAX_COVERED_PERCENT} * n_words AND n_long = 0 AS kept
FROM c"""

QUERIES = {"op3_suffix_repetition": op3_suffix_repetition}
ORACLES = {"op3_suffix_repetition": ORACLE_SQL}
