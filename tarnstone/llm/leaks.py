"""Evaluation texts leaking into training text (problem 9): a broadcast set of normalised test n-grams.

Texts are brought to words that ignore case, punctuation, spacing, accents, markup and invisible characters; each sign of
a script that is written without spaces (Chinese, Japanese) is a word. A leak is a run of ``n`` words of an item (or all
its words, if it has fewer). The hashes of all such runs form the set; each task slides over the words of its documents,
with running sums, so that a window costs a few operations, and verifies every hit by its text. The set goes out in blocks
of ``BLOCK_BYTES`` of item text (about five times that in a worker); every block is one scan of the documents, nothing of
a document is shuffled, and the rows are the same for any number of blocks.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 12
#: Bytes of item text in one broadcast.
BLOCK_BYTES = 16 << 20
# A tag by the grammar of tags, of any length; possessive, so that an unfinished one costs one look.
_TAG = re.compile(r"""<!--.*?-->|</?([A-Za-z][\w:-]*+)(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+)*+\s*+/?+>""", re.S)
# Elements that stand inside a word or line; every other one ends a word.
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strong sub sup time tt u var wbr".split())
_LINK = re.compile(r"\]\([^()\s]*+\)")
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[^\W_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")


def fold(text: str) -> str:
    """The text without markup, accents and invisible characters, in folded case. Its length may change."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[1] is None or m[1].lower() in _INLINE else " ", text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    return text.replace("_", " ").replace("*", "").casefold()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(fold(text)) if text else []


def runs_of(words: list[str], n: int = N) -> list[tuple[str, ...]]:
    """The runs that make a leak: all n-grams, or the whole text if it is shorter."""
    if not words:
        return []
    return [tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]


def _hashes(words: list[str], cache: dict[str, int]) -> np.ndarray:
    """A 64-bit number for each word: the checksums of the word and of the word with a sign before it."""
    known = list(map(cache.get, words))
    if None in known:
        for k, h in enumerate(known):
            if h is None:
                b = words[k].encode("utf-8", "surrogatepass")
                known[k] = cache[words[k]] = zlib.crc32(b) << 32 | zlib.crc32(b, 0x9E3779B9)
        if len(cache) > 1 << 18:
            cache.clear()
    return np.array(known, np.uint64)


class Windows:
    """Hashes of all windows of one length over a row of words, from running sums: sum of word * P^place, brought to the
    same power. All arithmetic is modulo 2^64."""

    P, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, words: np.ndarray) -> np.ndarray:
        n = len(words) + 1
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = max(n, 2 * len(self.up))
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.P, np.uint64)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.INVERSE, np.uint64)]))
        return np.concatenate([[np.uint64(0)], np.cumsum(words * self.up[: len(words)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        return (sums[size:] - sums[:-size]) * self.down[:n] if n > 0 else np.empty(0, np.uint64)


class Index:
    """The runs of one block of items: sorted hashes, and for each the item and the text of the run, to verify a hit."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        windows, cache = Windows(), {}
        texts, hashes, owner, start, end, size = [], [], [], [], [], []
        base = 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            k = min(n, len(words))
            h = windows.of(windows.sums(_hashes(words, cache)), k)
            ends = np.cumsum([len(w) + 1 for w in words]) + base - 1
            starts = np.concatenate([[base], ends[:-1] + 1])
            texts.append(" ".join(words))
            base = int(ends[-1]) + 1
            hashes.append(h)
            owner.append(np.full(len(h), item, np.int64))
            start.append(starts[: len(h)])
            end.append(ends[k - 1 :])
            size.append(np.full(len(h), k, np.int64))
        self.text = " ".join(texts)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owner, self.start, self.end, self.size = [(np.concatenate(c)[order] if c else np.empty(0, np.int64)) for c in (owner, start, end, size)]
        self.lengths = sorted(set(self.size.tolist()))
        # one bit-like byte for each of the highest bits of a hash: most windows of a document fail there
        self.bits = max(12, min(24, int(len(self.hashes)).bit_length() + 3))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, words: list[str], windows: Windows, cache: dict[str, int]) -> list[tuple[int, int, int]]:
        """(item, first word, word after the last) of every run found, overlapping ones of an item joined."""
        found: dict[int, list[list[int]]] = {}
        if not self.lengths or len(words) < self.lengths[0]:
            return []
        sums = windows.sums(_hashes(words, cache))
        got: list[tuple[int, int, int]] = []
        for size in self.lengths:
            h = windows.of(sums, size)
            at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                if x < y:
                    text = " ".join(words[a : a + size])
                    got += [(a, int(self.owner[r]), size) for r in range(x, y) if self.size[r] == size and self.text[self.start[r] : self.end[r]] == text]
        for a, item, size in sorted(got):
            spans = found.setdefault(item, [])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], a + size)
            else:
                spans.append([a, a + size])
        return [(i, a, b) for i, spans in found.items() for a, b in spans]


def leak_spans(documents: DataFrame, items: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, word_start, word_end): every stretch of a document that an item shares, in words of ``words_of``.

    Null, empty and wordless texts on either side give no rows; repeated items are reported under each id; a document
    repeated under the same id is reported once per row. The items go out in blocks of about ``block_bytes`` of text, by a
    hash of the id; each block is one scan of the documents, and the rows don't depend on the number of blocks.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    its = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = its.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = None
    for block in range(blocks):
        mine = its.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        part = _scan(docs, Index([(r.item_id, r.text) for r in mine.collect()], n))
        out = part if out is None else out.unionByName(part)
    return out


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, windows, cache = shared.value, Windows(), {}
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                rows += [(doc, *h) for h in ix.hits(words_of(text), windows, cache)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "word_start", "word_end"])

    return docs.mapInPandas(run, "doc_id long, item_id long, word_start int, word_end int")


def leaks(documents: DataFrame, items: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id), distinct: the documents that hold a leak and the items that leaked."""
    return leak_spans(documents, items, n, block_bytes).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The documents in which no item leaked, with all their columns (null texts stay)."""
    bad = leaks(documents, items, n).select(F.col("doc_id").alias("_leaked")).distinct()
    return documents.join(bad, documents["doc_id"].cast("long") == bad["_leaked"], "left_anti")
