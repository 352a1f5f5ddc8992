"""Splitting oversized texts at natural boundaries by recursive bisection.

A text above the limit is cut at the strongest boundary near its midpoint (paragraph, sentence, line, word; inside a
word only where a run without whitespace is itself above the limit), the halves likewise while they exceed
the limit minus the overlap, and at last every piece takes whole words of the piece before it as overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.runtime import need

#: Boundaries from strong to weak; a cut lies at the end of the match.
STRENGTHS = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"(?:[.!?…][\"'”’)\]]*\s+|[。！？][”’」』）]*\s*)"),
    re.compile(r"\n\s*"),
    re.compile(r"\s+"),
)
#: How far from the midpoint, as a part of the piece's length, a stronger boundary is preferred to a nearer one.
REACH = 0.25


def _nearest(at: list[int], lo: int, hi: int, mid: int) -> int | None:
    """The member of the sorted list nearest to mid with lo < member < hi."""
    i = bisect_left(at, mid)
    best = None
    for k in (i - 1, i):
        if 0 <= k < len(at) and lo < at[k] < hi and (best is None or abs(at[k] - mid) < abs(best - mid)):
            best = at[k]
    return best


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Consecutive spans ``(start, end, forced)`` that cover the text; ``forced``: the cut at its start is inside a word."""
    places = [sorted({m.end() for m in p.finditer(text)}) for p in STRENGTHS]
    # The places just before whitespace let a run that fills the limit end there.
    before = sorted({m.start() for m in STRENGTHS[3].finditer(text)})
    spaces = None
    target = limit - overlap
    done: list[tuple[int, int, bool]] = []
    todo = [(0, len(text), False)]
    while todo:
        a, b, forced = todo.pop()
        if b - a <= target:
            done.append((a, b, forced))
            continue
        mid, reach = (a + b) // 2, (b - a) * REACH
        cut = None
        for at in places:
            x = _nearest(at, a, b, mid)
            if x is not None and abs(x - mid) <= reach:
                cut = x
                break
        if cut is None:  # no boundary near the middle: the nearest anywhere
            near = [x for at in (places[3], before) if (x := _nearest(at, a, b, mid)) is not None]
            cut = min(near, key=lambda x: abs(x - mid), default=None)
        if cut is None and b - a > limit:  # one run of text or of whitespace
            if text[a].isspace() or text[b - 1].isspace():
                if spaces is None:
                    spaces = [i for i in range(1, len(text)) if text[i].isspace() or text[i - 1].isspace()]
                cut = _nearest(spaces, a, b, mid)
            if cut is None:
                todo += [(mid, b, True), (a, mid, forced)]
                continue
        if cut is None:
            done.append((a, b, forced))  # a run that fits the limit, though with less overlap
            continue
        todo += [(cut, b, False), (a, cut, forced)]
    return done


def overlap_start(text: str, prev: int, start: int, end: int, limit: int, overlap: int, forced: bool) -> int:
    """Where a piece starts once it shares whole words of the piece before it; ``start`` if none fits.

    A cut inside a word shares nothing: what precedes it isn't a whole word.
    """
    if forced:
        return start
    lowest = max(prev, start - overlap, end - limit)
    if lowest >= start:
        return start
    if lowest > 0 and lowest != prev and not (text[lowest].isspace() or text[lowest - 1].isspace()):
        while lowest < start and not text[lowest].isspace():
            lowest += 1
    while lowest < start and text[lowest].isspace():
        lowest += 1
    return lowest


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """``(start, core_start, end, forced)`` of each piece: it holds ``text[start:end]``, of which ``text[start:core_start]`` is shared."""
    spans = cuts(text, limit, overlap)
    out = []
    for i, (a, b, forced) in enumerate(spans):
        out.append((overlap_start(text, spans[i - 1][0], a, b, limit, overlap, forced) if i else a, a, b, forced))
    return out


def split_texts(df: DataFrame, id_col: str, text: str, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """The pieces of every text longer than ``limit`` characters (code points).

    Texts within the limit, empty and null ones have no rows. Duplicate rows are split each. Returns ``id_col``,
    ``piece_no`` (from 0), ``start_char``, ``core_char``, ``end_char``, ``piece``, ``forced``: whether the piece
    starts inside a word, and ``unbroken``: whether its text has a run above the limit without whitespace (which is cut
    at ideographic full stops where it has any). The cores put end to end are the text itself.
    """
    need(df, id_col, text)
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    kind = dict(df.dtypes)[id_col]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["_id"], pdf["_text"], strict=True):
                unbroken = max(map(len, t.split()), default=0) > limit
                rows += [(i, k, a, c, b, t[a:b], f, unbroken) for k, (a, c, b, f) in enumerate(pieces(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "piece_no", "start_char", "core_char", "end_char", "piece", "forced", "unbroken"])

    long = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.length(text) > limit)
    return long.mapInPandas(cut, f"`{id_col}` {kind}, piece_no int, start_char int, core_char int, end_char int, piece string, forced boolean, unbroken boolean")
