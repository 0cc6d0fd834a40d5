"""Splitting oversized texts at natural boundaries, with overlap.

Tokens are estimated as code points / 3.5. Per text, the estimate's prefix sums and one
sorted array of cut positions per strength (blank line, list item or table row; sentence;
clause or line; word) are built once. Each piece ends at the last boundary under the
limit, found by binary search, of the strongest kind that still fills half of the limit;
where the text offers none it is cut hard, never inside a character with its marks. The
next piece steps back by at most the overlap, to the first boundary inside it.

Defined results: null, empty and short texts give no pieces (``only_oversized``) or one
piece; pieces are exact slices, so ``text[start:end]`` over the pieces covers the text;
``section_path`` and all other columns are carried along unchanged, null stays null;
clashing output names (``piece_no`` ...) are replaced; repeated rows of one key count once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The estimate is length * 2 / 7, rounded; in units of 1/14 token it stays integral.
UNITS_PER_CHAR, UNITS_PER_TOKEN = 4, 14

LIMIT_TOKENS, OVERLAP_TOKENS = 400, 40

_STRONG = re.compile(r"\n[ \t]*\n+|\n(?=[ \t]*(?:[-•*–|]|\d+[.)]|[a-z][.)])[ \t|]?)")
_SENTENCE = re.compile(r"(?:[.!?؟。！？…]+[\"'»”)\]]*)(?=\s|$)\s*|(?<=[^\W\d_][.!?؟])(?=[^\W\d_a-z])")
_CLAUSE = re.compile(r"[;:,،؛](?=\s)\s*|\n+")
_WORD = re.compile(r"\s+")
_JOINERS = "‍️"


def estimate(text: Column) -> Column:
    """Code points / 3.5, rounded; no ties are possible."""
    return F.round(F.length(text) / F.lit(3.5)).cast("int")


def _units(tokens: int) -> int:
    """Largest sum of units whose rounded estimate is at most ``tokens``."""
    return UNITS_PER_TOKEN * tokens + UNITS_PER_TOKEN // 2 - 1


def boundaries(text: str) -> list[list[int]]:
    """Sorted cut positions of the text by strength, strongest first."""
    return [[m.end() for m in rx.finditer(text) if 0 < m.end() < len(text)] for rx in (_STRONG, _SENTENCE, _CLAUSE, _WORD)]


def _inside_character(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would take a mark or joiner from its letter."""
    return 0 < at < len(text) and (unicodedata.combining(text[at]) > 0 or text[at] in _JOINERS or text[at - 1] in _JOINERS)


def _whole_character(text: str, at: int, step: int) -> int:
    """``at`` moved by steps until no character is cut; ``at`` itself if there is no such place."""
    moved = at
    while _inside_character(text, moved):
        moved += step
    return moved if 0 < moved < len(text) else at


def split_text(text: str, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int]]:
    """(start, end) of each piece of ``text``, in order."""
    n = len(text)
    prefix = range(0, UNITS_PER_CHAR * (n + 1), UNITS_PER_CHAR)  # prefix[i]: units of text[:i]
    room, back = _units(limit), _units(overlap)
    levels = boundaries(text)
    every = sorted({p for level in levels for p in level})
    out, start, covered = [], 0, 0
    while True:
        if prefix[n] - prefix[start] <= room:
            out.append((start, n))
            return out
        reach = bisect_right(prefix, prefix[start] + room) - 1
        least = max(covered + 1, start + (reach - start) // 2)
        end = 0
        for level in levels:
            i = bisect_right(level, reach) - 1
            if i >= 0 and level[i] >= least:
                end = level[i]
                break
        if not end:
            i = bisect_right(every, reach) - 1
            end = every[i] if i >= 0 and every[i] > max(covered, start + (reach - start) // 4) else _whole_character(text, reach, -1)
        out.append((start, end))
        covered = end
        earliest = bisect_left(prefix, prefix[end] - back)
        i = bisect_left(every, earliest)
        start = every[i] if i < len(every) and every[i] < end else min(_whole_character(text, earliest, 1), end)
        if start <= out[-1][0]:
            start = end


def split_oversized(
    df: DataFrame,
    keys: list[str],
    text: str = "text",
    limit: int = LIMIT_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    carry: tuple[str, ...] = ("section_path",),
) -> DataFrame:
    """(keys, carry, piece_no, start, end, piece, token_estimate) of the rows over the limit.

    Rows are filtered by their estimate in the JVM first, so Python sees only texts to cut.
    """
    rows = df.where(estimate(F.col(text)) > limit).select(*keys, *carry, F.col(text).alias("_text"))

    @F.pandas_udf("array<struct<piece_no:int,start:int,end:int,piece:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [
                    [(k, a, b, t[a:b]) for k, (a, b) in enumerate(split_text(t, limit, overlap))]
                    for t in batch
                ]
            )

    kept = rows.dropDuplicates(keys).withColumn("_piece", F.explode(cut("_text"))).drop("_text")
    return kept.select(*keys, *carry, "_piece.*").withColumn("token_estimate", estimate(F.col("piece")))
