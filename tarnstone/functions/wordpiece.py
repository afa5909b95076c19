"""Exact token counts by a WordPiece vocabulary, and the estimate where there is none."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection

_WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_]+|[^\w\s]|_")
LONGEST = 100


def pieces(word: str, vocabulary: Collection[str]) -> list[str] | None:
    """The longest known pieces from left to right, all but the first behind ``##``; None if the word has none."""
    if len(word) > LONGEST:
        return None
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return None
    return out


def count_tokens(text: str | None, vocabulary: Collection[str] | None) -> int | None:
    """Tokens of a text in lower case without accents; an unknown word is one token. Without vocabulary a quarter of the
    bytes, rounded up."""
    if text is None:
        return None
    if vocabulary is None:
        return -(-len(text.encode()) // 4)
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return sum(len(pieces(w, vocabulary) or [w]) for w in _WORD.findall(plain))
