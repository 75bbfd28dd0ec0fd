"""Splitting oversized items at natural boundaries.

Every character position of an item gets a boundary strength (paragraph, line, sentence,
clause, word, none). A sparse table over the strengths answers range-maximum queries: for
the piece that starts at ``s`` the strongest cut in the permissible window
``[s + min_piece, s + limit]`` is taken, the rightmost of equal ones, and the next piece
starts ``overlap`` bytes before that cut.

Only oversized items leave the JVM (the size test is a column expression); each is split
alone, so there is no shuffle and no group. The table is built over blocks of the text, so
memory follows the block and not the item.

Defined results: null ids, null items, null limits and items of at most ``limit`` bytes give no row;
a null or negative overlap counts as 0; an overlap over half of the limit counts as half of
it; limits under 8 bytes count as 8, so a piece always holds a character and moves on.
No piece is over the limit; a start that would fall inside a character moves to the
character's first byte, so an overlap is the wanted one plus at most three bytes. Repeated
rows are split once per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PIECES = "item_table string, item_id long, piece_index int, start_byte long, end_byte long, strength int, piece string"

#: Strength of a cut after the matched text, weakest first.
BOUNDARIES = (
    (1, re.compile(rb"[ \t]+|\xc2\xa0|\xe3\x80\x80")),
    (2, re.compile(rb"[,;:)\]]+[ \t]+|\xe3\x80\x81|\xef\xbc\x8c|\xe2\x80\x94")),
    (3, re.compile(rb"[.!?]+(?:[\"')\]]|\xe2\x80\x9d|\xe2\x80\x99)*[ \t]+|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xd8\x9f|\xe0\xa5\xa4[ \t]*")),
    (4, re.compile(rb"\r\n|\n|\r|\xe2\x80\xa8")),
    (5, re.compile(rb"(?:(?:\r\n|\n|\r(?!\n))[ \t]*){2,}|\xe2\x80\xa9")),
)
MARKS = re.compile("[̀-ͯ‍︀-️ऀ-ःऺ-्\U0001f3fb-\U0001f3ff]+")
NO_CUT, BLOCK = -1, 1 << 16


def strengths(data: bytes) -> np.ndarray:
    """Strength of a cut before each byte and at the end; -1 inside a character or a CRLF."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(len(data) + 1, np.int8)
    for strength, pattern in BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(data)), np.int64)
        out[ends] = strength
    out[:-1][(raw & 0xC0) == 0x80] = NO_CUT
    out[1:-1][(raw[:-1] == 13) & (raw[1:] == 10)] = NO_CUT
    if len(raw) and (raw >= 0xCC).any():
        text = data.decode("utf-8", "surrogatepass")
        marks = [k for m in MARKS.finditer(text) for k in range(m.start(), m.end())]
        if marks:
            out[np.flatnonzero((raw & 0xC0) != 0x80)[marks]] = NO_CUT
    out[0] = NO_CUT
    return out


class SparseTable:
    """Rightmost range maximum over a block: one level for every power of two up to ``width``."""

    def __init__(self, values: np.ndarray, width: int):
        position = np.arange(len(values), dtype=np.int64)
        self.levels = [(values.astype(np.int64) << 40) | position]
        step = 1
        while step * 2 <= min(width, len(values)):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-step], below[step:]))
            step *= 2

    def best(self, low: int, high: int) -> int:
        """Position of the largest value in ``[low, high]``, the rightmost of equal ones."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1])) & ((1 << 40) - 1)


def cut_points(data: bytes, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of every piece."""
    limit = max(8, limit)
    overlap = min(max(0, overlap), limit // 2)
    size = len(data)
    if size <= limit:
        return [(0, size, 5)]
    level = strengths(data)
    floor = max(limit // 2, overlap + 4)
    pieces, start, base, table = [], 0, 0, None
    while size - start > limit:
        low, high = start + floor, start + limit
        if table is None or high - base >= block:
            base, block = start, max(BLOCK, 4 * limit)
            table = SparseTable(level[base : base + block], limit)
        end = base + table.best(low - base, high - base)
        if level[end] < 0:  # nothing but one unbroken cluster: cut before its last character
            end = high
            while data[end] & 0xC0 == 0x80:
                end -= 1
        pieces.append((start, end, int(max(level[end], 0))))
        start = end - overlap
        while data[start] & 0xC0 == 0x80:
            start -= 1
    pieces.append((start, size, 5))
    return pieces


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for table, item, text, limit, overlap in batch.itertuples(index=False):
            data = text.encode("utf-8", "surrogatepass")
            for k, (a, b, s) in enumerate(cut_points(data, int(limit), int(overlap))):
                rows.append((table, item, k, a, b, s, data[a:b].decode("utf-8", "replace")))
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
                rows = []
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def split_oversized(df: DataFrame, table: str, id_col: str, text_col: str, limit: Column, overlap: Column) -> DataFrame:
    """Pieces of every row of ``df`` whose text is over ``limit`` bytes; see the module text."""
    limit, overlap = limit.cast("long"), F.coalesce(overlap.cast("long"), F.lit(0))
    return (
        df.filter(F.col(id_col).isNotNull() & limit.isNotNull() & (F.octet_length(text_col) > F.greatest(limit, F.lit(8))))
        .select(F.lit(table).alias("t"), F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("x"), limit.alias("n"), overlap.alias("o"))
        .mapInPandas(_split_batches, PIECES)
    )
