"""Splitting oversized items at natural boundaries.

Method: a hierarchy of separators, from the coarsest to single letters. Pieces are packed greedily up
to the limit; a piece ends at the last boundary of the coarsest level that has one in reach, and the
next piece begins a given overlap before that end.

Three uses share it: plain text (section, paragraph, sentence, word, letter), residues (gap, letter)
and location text (element of the outermost list, then of inner lists, then letter).

Defined cases: null and empty items and items up to the limit give no row; repeated rows of one id
and text count once. Places count characters from 0, ends exclusive. Only oversized items reach
Python, filtered by length in the scan stage; there is no shuffle but for the removal of repeats
among the oversized ones.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESIDUE_LIMIT, RESIDUE_OVERLAP, LOCATION_LIMIT = 2000, 100, 200
#: Boundaries stand at the end of a match; a later level also ends where an earlier one does.
TEXT_LEVELS = (r"\n\s*\n\s*\n+", r"\n\s*\n+", r"\n|[.!?…]+[\"'”’)]*\s+|[。！？]+", r"\s+")
RESIDUE_LEVELS = (r"[nNxX]{10,}",)
_SCHEMA = "row_id long, piece int, piece_start long, piece_end long"


def boundaries(text: str, pattern: str) -> list[int]:
    return [m.end() for m in re.finditer(pattern, text)]


def cut_points(levels: list[list[int]], length: int, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Pieces of at most ``limit``; each but the last is longer than ``least`` if a boundary decides.

    ``levels`` are sorted boundaries, coarsest first; where none has one in reach, the cut is at the limit.
    """
    out, start = [], 0
    while length - start > limit:
        end = start + limit
        for level in levels:
            at = bisect_right(level, start + limit) - 1
            if at >= 0 and level[at] > start + least:
                end = level[at]
                break
        out.append((start, end))
        start = max(end - overlap, start + 1)
    out.append((start, length))
    return out


def split_text(text: str, limit: int, overlap: int, levels=TEXT_LEVELS, least: int | None = None) -> list[tuple[int, int]]:
    """Pieces of a text. ``least`` defaults to half the limit, and is never below the overlap."""
    least = max(limit // 2 if least is None else least, overlap)
    if limit <= overlap:
        raise ValueError("the limit must exceed the overlap")
    return cut_points([boundaries(text, p) for p in levels], len(text), limit, overlap, least)


def elements(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Parts of text[start:end] between the commas that stand outside brackets."""
    out, depth, at = [], 0, start
    for m in re.compile(r"[(),]").finditer(text, start, end):
        c = m[0]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth <= 0:
            out.append((at, m.start()))
            at = m.end()
    out.append((at, end))
    return out


_LIST = re.compile(r"(?:join|order|bond|one-of|complement)\(")


def outer_list(text: str, start: int = 0, end: int | None = None) -> tuple[int, int] | None:
    """Inside of the outermost list: operator and brackets go, enclosing ``complement(`` too."""
    end = len(text) if end is None else end
    while (m := _LIST.match(text, start, end)) and text[end - 1] == ")" and _closes(text, m.end() - 1, end - 1):
        inside = (m.end(), end - 1)
        if not m[0].startswith("complement"):
            return inside
        start, end = inside
    return None


def _closes(text: str, opening: int, closing: int) -> bool:
    depth = 0
    for m in re.compile(r"[()]").finditer(text, opening, closing + 1):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start() == closing
    return False


def split_location(text: str, limit: int = LOCATION_LIMIT, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Pieces of whole consecutive elements; each begins with the last element of the one before.

    An element above the limit is split by its own inner list, without overlap to its neighbours, and
    by letters if it has none. Where the shared element leaves no room for the next one, the next
    piece begins with that one.
    """
    end = len(text) if end is None else end
    inside = outer_list(text, start, end)
    if inside is None:
        return [(a, min(a + limit, end)) for a in range(start, end, limit)]
    parts, out, i = elements(text, *inside), [], 0
    while i < len(parts):
        a, b = parts[i]
        if b - a > limit:
            out += split_location(text, limit, a, b)
            i += 1
            continue
        j = i
        while j + 1 < len(parts) and parts[j + 1][1] - a <= limit:
            j += 1
        out.append((a, parts[j][1]))
        if j + 1 >= len(parts):
            break
        shares = j > i and parts[j + 1][1] - parts[j][0] <= limit
        i = j if shares else j + 1
    return out


def _pieces_of(df: DataFrame, split, field: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, ends = [], [], [], []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, (a, b) in enumerate(split(text.as_py()), 1):
                    ids.append(row_id)
                    numbers.append(n)
                    starts.append(a)
                    ends.append(b)
            arrays = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row_id", "piece", "piece_start", "piece_end"])

    return df.mapInArrow(run, _SCHEMA).select(F.lit(field).alias("field"), "*")


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    big = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    return big.dropDuplicates()


def residue_pieces(records: DataFrame, limit: int = RESIDUE_LIMIT, overlap: int = RESIDUE_OVERLAP) -> DataFrame:
    return _pieces_of(oversized(records, "record_id", "residues", limit), lambda t: split_text(t, limit, overlap, RESIDUE_LEVELS), "residues")


def location_pieces(features: DataFrame, limit: int = LOCATION_LIMIT) -> DataFrame:
    return _pieces_of(oversized(features, "feature_id", "location_gb", limit), lambda t: split_location(t, limit), "location")


def text_pieces(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, levels=TEXT_LEVELS) -> DataFrame:
    return _pieces_of(oversized(df, id_col, text_col, limit), lambda t: split_text(t, limit, overlap, levels), text_col)
