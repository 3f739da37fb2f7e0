"""Passages of a text with their lines in one linear pass, as an Arrow UDF.

The same passages as `text.split_passages`, whose column expression takes substrings from a text's start for each of its chunks, and so
grows with the square of its length; here 50 MB take seconds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import OVERLAP, TARGET

SCHEMA = "array<struct<ordinal:int,char_start:int,char_end:int,line_start:int,line_end:int,text:string>>"
#: Bytes of texts of a batch that are Python strings at a time.
PIECE = 2_000_000
#: The characters of Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"
_UPTO_SPACE, _INK = re.compile(f"(?s).*[{SPACE}]"), re.compile(f"[^{SPACE}]")


def chunks(text: str, target: int = TARGET, overlap: int = OVERLAP):
    """(start, end) of each chunk: it ends after the last white space in its last two fifths, else at `target`
    characters; the next starts `overlap` characters before its end."""
    start, n, floor = 0, len(text), target * 3 // 5
    while start < n:
        end = n
        if start + target < n:
            soft = _UPTO_SPACE.match(text[start + floor : start + target])
            end = start + (floor + soft.end() if soft else target)
        yield start, end
        start = n if end >= n else end - min(overlap, end - start - 1)


def passages(text: str, target: int = TARGET, overlap: int = OVERLAP):
    """(char_start, char_end, line_start, line_end) of the chunks that are not blank; lines count from 1."""
    seen, line = 0, 1
    for start, end in chunks(text, target, overlap):
        line += text.count("\n", seen, start)
        seen = start
        if _INK.search(text, start, end):
            yield start, end, line, line + text.count("\n", start, end)


def pieces(sizes: np.ndarray, most: int):
    """Bounds of runs of rows whose sizes add up to about `most`; a row is never cut."""
    number = (np.cumsum(sizes) - sizes) // most
    at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]][: len(sizes)])
    return zip(at.tolist(), [*at[1:].tolist(), len(sizes)][: len(at)], strict=True)


def split_passages(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """array<struct<ordinal, char_start, char_end, line_start, line_end, text>>; null for null."""

    @F.arrow_udf(SCHEMA)
    def split(texts: pa.Array) -> pa.Array:
        size = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64) + 1
        some = [_split(texts.slice(lo, hi - lo), target, overlap) for lo, hi in (pieces(size, PIECE) if len(size) else [(0, 0)])]
        return pa.concat_arrays(some)

    return split(text)


def passage_count(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """How many passages `split_passages` makes of a text, without their texts; 0 for null."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        size = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64) + 1
        return pa.array([sum(1 for _ in passages(x or "", target, overlap)) for lo, hi in pieces(size, PIECE) for x in texts.slice(lo, hi - lo).to_pylist()], pa.int64())

    return counted(text)


def _split(texts: pa.Array, target: int, overlap: int) -> pa.Array:
    offsets, null, columns = [0], [], [[], [], [], [], [], []]
    for value in texts.to_pylist():
        null.append(value is None)
        for i, place in enumerate(passages(value, target, overlap) if value else ()):
            for column, x in zip(columns, (i, *place, value[place[0] : place[1]]), strict=True):
                column.append(x)
        offsets.append(len(columns[0]))
    names = ("ordinal", "char_start", "char_end", "line_start", "line_end")
    struct = pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:5]), pa.array(columns[5], pa.string())], [*names, "text"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct, mask=pa.array(null, pa.bool_()))
