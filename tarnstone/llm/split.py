"""Splitting oversized items at natural boundaries (problem 6): lexical-cohesion segmentation.

A piece starts where the last one ended, less the overlap. Inside its size window every run of white space is a possible
cut, of one of four classes: paragraph, line, sentence, word. Among the cuts of the best class in the second half of the
window (of the whole window, if that half has none) the one with the deepest valley is taken: the words just before a
cut and just after it are compared by the cosine of their counts, and the depth of a cut is how far this similarity lies
below the highest similarity to its left and to its right within the window. A stretch without white space that is
longer than a piece may be is cut hard, which makes the piece, and its item, ``forced``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP_CHARS, OVERLAP_LINES, BLOCK = 800, 200, 3, 24
PARAGRAPH, LINE, SENTENCE, WORD = range(4)
_GAP = re.compile(r"[ \t\r\n]+")
_TOKEN = re.compile(r"\w{3,}")
PIECES = "item_kind string, item_id long, piece_no int, char_start int, char_end int, start_line long, cut string"


def _class(text: str, start: int, end: int) -> int:
    """The class of the white-space run text[start:end]."""
    breaks = text.count("\n", start, end) or text.count("\r", start, end)
    if breaks > 1:
        return PARAGRAPH
    if breaks:
        return LINE
    return SENTENCE if text[start - 1] in ".!?…。:;" else WORD


def _similarity(text: str, at: int) -> float:
    """Cosine of the word counts of the blocks before and after a cut."""
    a = Counter(_TOKEN.findall(text, max(0, at - BLOCK * 8), at))
    b = Counter(_TOKEN.findall(text, at, at + BLOCK * 8))
    if not a or not b:
        return 0.0
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5


def deepest_valley(text: str, cuts: list[int]) -> int:
    """The cut (of cuts in ascending order) with the deepest valley; of equal ones the last."""
    if len(cuts) == 1:
        return cuts[0]
    sims = [_similarity(text, c) for c in cuts]
    left, peak = [], 0.0
    for s in sims:
        peak = max(peak, s)
        left.append(peak)
    best, at, peak = -1.0, cuts[-1], 0.0
    for k in range(len(cuts) - 1, -1, -1):
        peak = max(peak, sims[k])
        depth = left[k] + peak - 2 * sims[k]
        if depth > best:
            best, at = depth, cuts[k]
    return at


def _overlap_start(text: str, start: int, end: int, resume: int, need: int, limit: int, chars: int, lines: int | None) -> int:
    """Where the next piece begins: at most ``chars`` (or ``lines`` lines) before ``end``, at a word or line.

    ``need`` is the first place after ``end`` at which the next piece can end, so that it never falls behind.
    """
    earliest = max(start + 1, need - limit)
    if earliest >= end:
        return resume
    if lines is None:
        gap = _GAP.search(text, max(earliest, end - chars) - 1, end)
        return gap.end() if gap and gap.end() < end else resume
    at, found = end, resume
    for _ in range(lines):
        # the end of the line before: \n, or \r alone (of \r\n the \n is met first)
        at = max(text.rfind("\n", start, at), text.rfind("\r", start, at))
        if at < 0 or at + 1 < earliest:
            break
        found = at + 1
        if text[at] == "\n" and at > start and text[at - 1] == "\r":
            at -= 1
    return found


def split(text: str, limit: int = LIMIT, chars: int = OVERLAP_CHARS, lines: int | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces of a text, each at most ``limit`` characters (code points).

    Every character that isn't white space at a cut is in a piece. A text within the limit is one piece; one without a
    visible character is cut every ``limit`` characters, without overlap. ``lines`` set: pieces overlap by that many whole lines, else by up to ``chars`` characters.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, False)]
    if not text.strip(" \t\r\n"):
        return [(a, min(n, a + limit), False) for a in range(0, n, limit)]
    out: list[tuple[int, int, bool]] = []
    head = _GAP.match(text)
    start, done = (head.end() if head else 0), 0
    n = len(text.rstrip(" \t\r\n"))
    while True:
        if n - start <= limit:
            out.append((start, n, False))
            return out
        by_class: list[list[int]] = [[], [], [], []]
        for g in _GAP.finditer(text, max(start, done), min(n, start + limit + 1)):
            a = g.start()
            if a > start and a > done and a - start <= limit:
                by_class[_class(text, a, _GAP.match(text, a).end())].append(a)
        forced = False
        if any(by_class):
            half = start + limit // 2
            late = [[c for c in cs if c > half] for cs in by_class]
            cuts = next((cs for cs in late if cs), None) or next(cs for cs in by_class if cs)
            end = deepest_valley(text, cuts)
        else:
            end, forced = start + limit, True
        out.append((start, end, forced))
        done = end
        gap = _GAP.match(text, end)
        resume = gap.end() if gap else end
        if resume >= n:
            return out
        after = _GAP.search(text, resume)
        need = after.start() if after else n
        start = resume if forced or need - resume > limit else _overlap_start(text, start, end, resume, need, limit, chars, lines)


def lines_before(text: str, places: list[int]) -> list[int]:
    """How many lines have ended before each of the ascending places; the text is read once."""
    out, done, n = [], 0, 0
    for at in places:
        n += text.count("\n", done, at) + text.count("\r", done, at) - text.count("\r\n", max(0, done - 1), at)
        done = max(done, at)
        out.append(n)
    return out


def _pieces(kind: str, lines: int | None, limit: int, chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text, first in zip(pdf["item_id"], pdf["text"], pdf["first"], strict=True):
                pieces = split(text, limit, chars, lines)
                before = lines_before(text, [a for a, _, _ in pieces]) if lines is not None else [0] * len(pieces)
                for no, ((a, b, forced), n) in enumerate(zip(pieces, before, strict=True), 1):
                    line = None if first is None or pd.isna(first) else int(first) + n
                    rows.append((kind, item, no, a, b, line, "forced" if forced else "natural"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"start_line": "Int64"})

    return run


def oversized(df: DataFrame, id_col: str, text_col: str, line_col: str | None, limit: int = LIMIT) -> DataFrame:
    first = F.col(line_col).cast("long") if line_col else F.lit(None).cast("long")
    return df.where(F.char_length(text_col) > limit).select(
        F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"), first.alias("first")
    )


def split_items(meetings: DataFrame, chunks: DataFrame, limit: int = LIMIT, chars: int = OVERLAP_CHARS, lines: int = OVERLAP_LINES) -> DataFrame:
    """One row per piece of every item over ``limit`` characters: see ``PIECES`` for the columns.

    Null, empty and short texts are no cases. Offsets count code points. start_line is null for meetings and for chunks
    whose own start_line is null (a wrong one is taken as it stands). Rows repeated under another id are cut alike.
    """
    m = oversized(meetings, "id", "transcript", None, limit).mapInPandas(_pieces("meeting", None, limit, chars), PIECES)
    c = oversized(chunks, "id", "chunk_text", "start_line", limit).mapInPandas(_pieces("chunk", lines, limit, chars), PIECES)
    return m.unionByName(c)


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """(item_kind, item_id, cut_kind): ``forced`` if any piece of the item had to be cut inside a word."""
    return pieces.groupBy("item_kind", "item_id").agg(
        F.when(F.max(F.col("cut") == "forced"), "forced").otherwise("natural").alias("cut_kind")
    )
