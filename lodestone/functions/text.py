"""Text functions as Spark columns: tokenizers, normalisation, passages, hashed embeddings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET, OVERLAP = 1000, 120
DIMENSION = 128


def _folds() -> tuple[str, str]:
    """Latin letters with diacritics and their base letters, from their canonical decompositions."""
    source, target = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(x) for x in parts[1:]) and chr(point).islower():
            source.append(chr(point))
            target.append(parts[0])
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _folds()


def normalized_lines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def tokenize_fts(text: Column) -> Column:
    """Full-text tokens: lower case, diacritics of Latin letters off, runs of letters and digits."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def tokenize_alnum(text: Column) -> Column:
    """Embedding tokens: runs of letters and digits, lower case, diacritics kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def normalize_fusion(text: Column) -> Column:
    """Lower case, every run of other characters one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokenize_alnum(text))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a character offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def split_passages(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Passages as array<struct<ordinal, char_start, char_end, text>>.

    A chunk ends after the last white space in its last two fifths, else at `target` characters; the
    next starts `overlap` characters before. Blank chunks get no ordinal."""
    n = F.length(text)
    floor = target * 3 // 5

    def stop(start: Column) -> Column:
        tail = F.substring(text, start + floor + 1, F.lit(target - floor))
        soft = F.length(F.regexp_extract(tail, r"(?Us)^(.*\s)", 1))
        return F.when(start + target >= n, n).when(soft > 0, start + floor + soft).otherwise(start + target)

    def step(state: Column, _: Column) -> Column:
        end = stop(state["start"])
        done = F.struct(state["start"].alias("char_start"), end.alias("char_end"))
        after = F.when(end >= n, n).otherwise(end - F.least(F.lit(overlap), end - state["start"] - 1))
        return F.when(state["start"] >= n, state).otherwise(F.struct(after.alias("start"), F.concat(state["found"], F.array(done)).alias("found")))

    most = F.floor(n / max(1, floor - overlap)) + 1
    zero = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<char_start:int,char_end:int>>").alias("found"))
    chunks = F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda s: s["found"])
    texts = F.transform(chunks, lambda c: F.struct(c["char_start"].alias("char_start"), c["char_end"].alias("char_end"), F.substring(text, c["char_start"] + 1, c["char_end"] - c["char_start"]).alias("text")))
    kept = F.filter(texts, lambda c: c["text"].rlike(r"(?U)\S"))
    return F.transform(kept, lambda c, i: F.struct(i.alias("ordinal"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end"), c["text"].alias("text")))


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def char_trigrams(text: Column) -> Column:
    """Every three characters, A-Z lower-cased."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # bound once: in the inner function the expression would be made again for each place
    of = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    return F.when(F.length(text) >= 3, F.element_at(F.transform(F.array(low), of), 1)).otherwise(F.array().cast("array<string>"))


def hash_bucket(term: Column, dimension: int = DIMENSION) -> Column:
    """Bucket of a term from the first byte of its SHA-256 (dimension: a power of two up to 256)."""
    return (F.conv(F.substring(F.sha2(term, 256), 1, 2), 16, 10).cast("int") % dimension).cast("int")


def hash_sign(term: Column) -> Column:
    """1.0 or -1.0 by the lowest bit of the ninth byte of the SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(term, 256), 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def hash_features(text: Column, bigram_weight: float = 0.5) -> Column:
    """array<struct<term, weight>> of the hashed embedding: tokens at 1, bigrams at bigram_weight."""
    tokens = tokenize_alnum(text)
    return F.concat(F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight"))), F.transform(bigrams(tokens), lambda t: F.struct(t.alias("term"), F.lit(bigram_weight).alias("weight"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a norm is near 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms <= 2.220446049250313e-16, 0.0).otherwise(dot(a, b) / norms)
