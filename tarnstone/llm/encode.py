"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8).

The vocabulary is a parameter: a file of base64 byte strings with their ranks. A text is cut by the vocabulary's
pattern; a piece that is itself in the vocabulary is one id; any other piece is merged by ``merge_piece``. Pieces repeat
heavily, so each Python worker keeps the ids of the pieces it has met, up to a bound.

The driver reads the file and ships its bytes; a worker parses them once, for all its tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces remembered by a worker, and the longest piece worth remembering (bytes).
CACHE_PIECES, CACHE_BYTES = 200_000, 64
_NONE = 1 << 60


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(Path(path).read_bytes())


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by byte-pair merging, lowest rank first, leftmost first among equals.

    A segment tree over the byte positions holds the minimum of (rank, position) of the pair that starts there; a merge
    takes the root, removes the right part from the list of live parts and updates the three positions whose pair
    changed, each in a logarithmic number of steps: O(n log n) for a piece of n bytes of any kind.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1
    while size < n:
        size *= 2
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    # one integer holds (rank, position), so that min() finds the leftmost of the lowest rank
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = (r << 32) | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        j = nxt[i]
        if j >= n:
            return _NONE
        r = get(piece[i : nxt[j]])
        return _NONE if r is None else (r << 32) | i

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = nxt[i]
        after = nxt[j]
        nxt[i] = after
        if after < n:
            prv[after] = i
        put(j, _NONE)
        put(i, pair(i))
        if prv[i] >= 0:
            put(prv[i], pair(prv[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : nxt[i]]])
        i = nxt[i]
    return out


def encoder(path: str, pattern: str) -> Callable[[str | None], list[int]]:
    """A function from text to ids; null and empty text give the empty list."""
    return Vocabulary(Path(path).read_bytes(), pattern).encoder()


class Vocabulary:
    """The bytes of a vocabulary file and its pattern; where it is used, the encoder made of them is kept with it."""

    def __init__(self, raw: bytes, pattern: str):
        self.raw, self.pattern, self.made = raw, pattern, None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "pattern": self.pattern, "made": None}

    def encoder(self) -> Callable[[str | None], list[int]]:
        if self.made is None:
            self.made = _encoder(parse_ranks(self.raw), self.pattern)
        return self.made


def _encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str | None], list[int]]:
    import regex

    cut = regex.compile(pattern)
    known: dict[str, list[int]] = {}

    def ids_of(piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        r = ranks.get(raw)
        ids = [r] if r is not None else merge_piece(raw, ranks)
        if len(raw) <= CACHE_BYTES:
            if len(known) >= CACHE_PIECES:
                known.clear()
            known[piece] = ids
        return ids

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        get, extend = known.get, out.extend
        for piece in cut.findall(text):
            extend(get(piece) or ids_of(piece))
        return out

    return encode


def encode_corpus(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id BIGINT, ids ARRAY<INT>) of every row, without special tokens.

    Null and empty texts give the empty list; repeated rows come out repeated; a text of any length is one task's work
    and is encoded whole. Strings of special tokens are ordinary text. ``path`` is read on the driver.
    """
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(Path(path).read_bytes(), pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = shared.value.encoder()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [encode(t) if isinstance(t, str) else [] for t in pdf["text"]]})

    return slim.mapInPandas(run, "doc_id long, ids array<int>")
