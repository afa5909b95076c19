"""Text functions: query normalisation, tokens, stems, excerpts, slugs and chunking."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words too common to say what a query is about.
STOPWORDS = (
    "a about after all also an and any are as at be been being but by can could did do does each for from get had has have how i if in into is "
    "it its just me must my not now of off on one or our out per set should so some than that the their them then there these they this those to "
    "us use used uses very via was we were what when where which who why will with would you your"
).split()
# The shorter list for near-duplicate scoring.
DUPLICATE_STOPWORDS = (
    "the and for are was were with that this from have has had not but its into when then than them they use used uses via per can will should "
    "must which each any all one now how why what who our out off get set"
).split()
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOOSE_LIMIT, CODE_TERMS = 10, 16


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- query text, on the driver ----------------------------------------------------------------------------------------


def sanitize(query: str) -> list[str]:
    """The terms of a strict search: split at white space, quotation marks removed, none empty."""
    return [t for t in (w.replace('"', "") for w in query.split()) if t]


def loose_terms(query: str) -> list[str] | None:
    """The terms of an any-term search; None if it would be the strict search again.

    A term is a stop-word by its letters and digits; if all are, they all stay.
    """
    terms = sanitize(query)
    bare = [(t, t.strip("".join(c for c in set(t) if not c.isalnum()))) for t in terms]
    kept = [t for t, b in bare if b and b.lower() not in STOPWORDS] or [t for t, b in bare if b]
    return None if not kept or len(terms) == 1 and len(kept) == 1 else kept


def code_terms(query: str) -> list[str]:
    """Up to 16 different words of three or more letters of a question of two or more words."""
    words = query.split()
    if len(words) < 2:
        return []
    trimmed = [re.sub(r"^[^\w]+|[^\w]+$", "", w).lower() for w in words]
    return list(dict.fromkeys(w for w in trimmed if len(w) >= 3 and w not in STOPWORDS))[:CODE_TERMS]


def trigram_terms(query: str) -> list[str]:
    """The terms of a substring index search: those of three or more characters."""
    return [t for t in sanitize(query) if len(t) >= 3]


# -- tokens -----------------------------------------------------------------------------------------------------------


def fold_word(word: str) -> str:
    text = unicodedata.normalize("NFKD", word)
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def word_parts(word: str) -> list[str]:
    """The parts of a joined word (HTTPServer, utf8Decoder): none if it is one part, none of a single letter."""
    word = "".join(c for c in word if not unicodedata.combining(c))
    cuts = [0]
    for k in range(1, len(word)):
        a, b, after = word[k - 1], word[k], word[k + 1 : k + 2]
        if b.isupper() and (a.islower() or a.isdigit()) or b.isupper() and a.isupper() and after.islower():
            cuts.append(k)
    if len(cuts) == 1:
        return []
    return [p for p in (word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)) if len(p) >= 2]


def _measure(stem: str) -> int:
    return len(re.findall(r"[aeiouy]+[^aeiouy]+", _classes(stem)))


def _classes(word: str) -> str:
    """The word with y as a vowel only after a consonant: other y become j."""
    return re.sub(r"(^|[aeiou])y", r"\1j", word)


def _has_vowel(stem: str) -> bool:
    return bool(re.search(r"[aeiouy]", _classes(stem)))


def _ends_cvc(word: str) -> bool:
    w = _classes(word)
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxj]$", w)) and word[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _longest(word: str, table: str) -> tuple[str, str] | None:
    pairs = [(p.partition(":")[0], p.partition(":")[2]) for p in table.split(" ")]
    hits = [p for p in pairs if word.endswith(p[0])]
    return max(hits, key=lambda p: len(p[0])) if hits else None


def stem(word: str) -> str:
    """Porter's stemmer (1980) for lower-case English words; shorter or other words stay as they are."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = _longest(w, table)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = _longest(w, _STEP4)
    if hit:
        base = w[: -len(hit[0])]
        if _measure(base) > 1 and (hit[0] != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _ends_cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def word_terms(word: str, parts: bool, stems: bool) -> list[tuple[str, bool]]:
    """(term, is a part) of one word."""
    form = fold_word(word)
    out = [(stem(form) if stems else form, False)]
    if parts:
        out += [(stem(fold_word(p)) if stems else fold_word(p), True) for p in word_parts(word)]
    return out


def tokens(text: str, parts: bool = True, stems: bool = True, known: dict | None = None) -> list[tuple[int, str, bool]]:
    """(position, term, is a part): words of letters and digits, folded and stemmed; parts share their word's position.

    ``known`` keeps the terms of words between calls, for a caller with many texts.
    """
    known, out = {} if known is None else known, []
    for at, word in enumerate(re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text))):
        terms = known.get(word)
        if terms is None:
            if len(known) > 200_000:
                known.clear()
            terms = known[word] = word_terms(word, parts, stems)
        out += [(at, t, p) for t, p in terms]
    return out


# -- column expressions -----------------------------------------------------------------------------------------------


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A to Z only, as the substring tier compares."""
    return F.translate(col(c), ASCII_UPPER, ASCII_LOWER)


def token_lower(c: Column | str) -> Column:
    """Lower case in which only A to Z become a to z: the fast form where nothing else is looked for than ASCII.

    Of all other letters only the Kelvin sign and the dotted I have an ASCII letter in their lower case.
    """
    t = col(c)
    return F.when(F.contains(t, F.lit("\u212a")) | F.contains(t, F.lit("\u0130")), ascii_lower(t)).otherwise(F.lower(t))


def _accented() -> tuple[str, str]:
    """The precomposed letters of the Latin blocks and the letters they are made from."""
    pairs = [(chr(k), unicodedata.normalize("NFKD", chr(k))) for k in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _accented()


def without_accents(c: Column | str) -> Column:
    """The text with its Latin letters plain and without combining marks; case stays."""
    return F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), r"\p{M}", "")


def contains_literal(c: Column | str, needle: str) -> Column:
    """Substring match in which no character is a wild card, ASCII case folded."""
    if needle.isascii():
        return F.contains(token_lower(c), F.lit(needle.lower()))
    return F.contains(ascii_lower(c), ascii_lower(F.lit(needle)))


def simple_tokens(c: Column | str) -> Column:
    """Words of a-z and 0-9 after ASCII lower case."""
    return F.array_remove(F.split(token_lower(c), "[^a-z0-9]+"), "")


def significant_tokens(c: Column | str) -> Column:
    """Distinct lower-case words of three or more bytes without the shorter stop-word list."""
    stop = F.array(*[F.lit(w) for w in DUPLICATE_STOPWORDS])
    words = F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(stop, w)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Part of a's tokens that b has; 0 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def truncate(c: Column | str, n: int) -> Column:
    """n characters and three dots, or the whole text."""
    return F.when(F.char_length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def excerpt(c: Column | str, query: str, n: int) -> Column:
    """About n characters around the first match of the query, or else of its first word of three or more letters."""
    low = ascii_lower(c)
    needles = [query.lower(), *[w.lower() for w in query.split() if len(w) >= 3][:1]]
    at = F.lit(0)
    for x in reversed(needles):
        at = F.when(F.locate(x, low) > 0, F.locate(x, low)).otherwise(at)
    start = F.greatest(at - n // 3, F.lit(1))
    piece = F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.substring(col(c), start, F.lit(n)))
    return F.when(F.char_length(col(c)) > start + n - 1, F.concat(piece, F.lit("..."))).otherwise(piece)


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def context(c: Column | str, n: int = 200) -> Column:
    """One line of at most n characters; null if nothing is left."""
    return F.nullif(F.substring(squeeze(c), 1, n), F.lit(""))


def passage(header: Column | str, text: Column | str) -> Column:
    """A text below its header and a blank line; without header, or with an empty one, the text."""
    return F.when(F.nullif(col(header), F.lit("")).isNull(), col(text)).otherwise(F.concat(col(header), F.lit("\n\n"), col(text)))


def slug(c: Column | str) -> Column:
    """ASCII letters and digits in lower case, all else one hyphen; ``unnamed`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("unnamed")).otherwise(s)


def key_path(c: Column | str) -> Column:
    """The slugs of the parts of a path."""
    return F.array_join(F.transform(F.split(col(c), "/"), slug), "/")


def without_private(c: Column | str) -> Column:
    """The text without its private regions; an unclosed one takes the rest with it."""
    return F.regexp_replace(col(c), r"(?is)<private>.*?(?:</private>|\z)", "")


def project_hash(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}-]", "-")


def signature(c: Column | str) -> Column:
    """The first line, without an opening brace at its end."""
    return F.regexp_replace(F.split(col(c), "\n")[0], r"\s*\{\s*$", "")


def first_line(c: Column | str, n: int) -> Column:
    return truncate(F.trim(F.regexp_replace(F.split(col(c), "\n")[0], r"\s+$", "")), n)


def probe_windows(c: Column | str, width: int, count: int) -> Column:
    """``count`` windows of ``width`` characters, evenly spaced from head to tail; equal starts once."""
    span = F.greatest(F.char_length(col(c)) - width, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(span * i / (count - 1)).cast("int") + 1)
    return F.transform(F.array_distinct(starts), lambda s: F.substring(col(c), s, F.lit(width)))


def names_query(c: Column | str, query: str) -> Column:
    return F.lower(F.trim(col(c))) == query.strip().lower()


def code_kind(c: Column | str) -> Column:
    """A node kind as words: without its grammar suffix."""
    return F.regexp_replace(F.regexp_replace(col(c), "_(item|declaration|definition|specifier)$", ""), "_", " ")


def normal_remote(url: str | None) -> str | None:
    """host/owner/repo of a remote address; None for paths of this machine."""
    if not url or not url.strip():
        return None
    u = url.strip()
    m = re.match(r"^(?:[a-z+]+)://(?:[^@/]+@)?([^/:]+)(?::\d+)?/(.+)$", u, re.I)
    if m and not u.lower().startswith("file:"):
        host, path = m[1], m[2]
    elif (m := re.match(r"^(?:[^@/\s]+@)?([^/:\s]{2,}):(?!\\)([^\s]+)$", u)) and "://" not in u and not re.match(r"^[A-Za-z]:[\\/]", u):
        host, path = m[1], m[2]
    else:
        return None
    path = re.sub(r"(?:\.git)?/*$", "", path.strip("/"))
    return f"{host.lower()}/{path}" if path else None


def yaml_quote(text: str) -> str:
    """A double-quoted YAML scalar."""
    known = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(known.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c) for c in text) + '"'


def terminal_safe(text: str) -> str:
    """A text without control characters but line ends: tabs are spaces, the others are written out."""
    return "".join(" " if c == "\t" else c if c == "\n" or unicodedata.category(c) != "Cc" else f"\\u{{{ord(c):x}}}" for c in text)


def truncate_bytes(text: str, n: int) -> str:
    """At most n bytes of UTF-8, no character cut, and three dots if anything is missing."""
    raw = text.encode()
    return text if len(raw) <= n else raw[:n].decode("utf-8", "ignore") + "..."


# -- the same as expressions ------------------------------------------------------------------------------------------


def truncated_bytes(c: Column | str, n: int) -> Column:
    """``truncate_bytes`` as an expression: the cut goes back over the at most three bytes that go on a character."""
    raw = col(c).cast("binary")
    goes_on = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")
    at = F.when(~goes_on(n + 1), n).when(~goes_on(n), n - 1).when(~goes_on(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(raw) <= n, col(c)).otherwise(F.concat(F.substring(raw, F.lit(1), at).cast("string"), F.lit("...")))


def _each(c: Column, signs: dict[str, str]) -> Column:
    for sign, form in signs.items():
        c = F.replace(c, F.lit(sign), F.lit(form))
    return c


#: Control characters without a short form, and how YAML and a terminal are given them.
CONTROLS = [k for k in [*range(32), *range(127, 160)] if chr(k) not in "\n\t\r"]


def yaml_quoted(c: Column | str) -> Column:
    """``yaml_quote`` as an expression."""
    plain = _each(col(c), {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"})
    rare = _each(plain, {chr(k): f"\\x{k:02x}" for k in CONTROLS if k < 128})
    return F.concat(F.lit('"'), F.when(col(c).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), rare).otherwise(plain), F.lit('"'))


def safe_for_terminal(c: Column | str) -> Column:
    """``terminal_safe`` as an expression."""
    plain = F.replace(col(c), F.lit("\t"), F.lit(" "))
    rare = _each(plain, {chr(k): f"\\u{{{k:x}}}" for k in [13, *CONTROLS]})
    return F.when(col(c).rlike(r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]"), rare).otherwise(plain)


REMOTE_URL = r"^[A-Za-z+]+://(?:[^@/]+@)?([^/:]+)(?::\d+)?/(.+)$"
REMOTE_SCP = r"^(?:[^@/\s]+@)?([^/:\s]{2,}):([^\\\s][^\s]*)$"


def remote(c: Column | str) -> Column:
    """``normal_remote`` as an expression."""
    u = F.trim(col(c))
    form = F.when(u.rlike(REMOTE_URL) & ~F.startswith(F.lower(u), F.lit("file:")), F.lit(1)).when(~F.contains(u, F.lit("://")) & u.rlike(REMOTE_SCP), F.lit(2))
    part = lambda k: F.when(form == 1, F.regexp_extract(u, REMOTE_URL, k)).otherwise(F.regexp_extract(u, REMOTE_SCP, k))
    path = F.regexp_replace(F.regexp_replace(part(2), "^/+|/+$", ""), r"(?:\.git)?/*$", "")
    return F.when(form.isNotNull() & (path != ""), F.concat(F.lower(part(1)), F.lit("/"), path))


def terms_of(c: Column | str) -> Column:
    """``sanitize`` as an expression."""
    return F.filter(F.transform(F.split(col(c), r"[ \t\n\r\f]+"), lambda w: F.replace(w, F.lit('"'), F.lit(""))), lambda w: w != "")


_BARE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def loose_terms_of(c: Column | str) -> Column:
    """``loose_terms`` as an expression."""
    terms, stop = terms_of(c), F.array(*[F.lit(w) for w in STOPWORDS])
    bare = lambda w: F.lower(F.regexp_replace(w, _BARE, ""))
    words = F.filter(terms, lambda w: bare(w) != "")
    kept = F.filter(words, lambda w: ~F.array_contains(stop, bare(w)))
    kept = F.when(F.size(kept) > 0, kept).otherwise(words)
    return F.when(~((F.size(kept) == 0) | ((F.size(terms) == 1) & (F.size(kept) == 1))), kept)


def code_terms_of(c: Column | str) -> Column:
    """``code_terms`` as an expression."""
    words = F.filter(F.split(col(c), r"[ \t\n\r\f]+"), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")))
    kept = F.array_distinct(F.filter(bare, lambda w: (F.char_length(w) >= 3) & ~F.array_contains(stop, w)))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.slice(kept, 1, CODE_TERMS))


# -- chunking ---------------------------------------------------------------------------------------------------------


def split_long(paragraph: str, limit: int) -> list[str]:
    """A paragraph in pieces of at most ``limit`` characters, each ending with the last line or word of its window.

    The window is the first ``limit`` characters; a gap that is its first character doesn't count, and without another
    one the window is cut hard. Only a paragraph that was cut loses the white space at the cuts.
    """
    out, rest = [], paragraph
    while len(rest) > limit:
        gap = max(rest.rfind("\n", 1, limit), rest.rfind(" ", 1, limit))
        cut = gap + 1 if gap > 0 else limit
        out.append(rest[:cut].rstrip())
        rest = rest[cut:].lstrip()
    return [x for x in [*out, rest] if x]


def overlap_tail(paragraph: str, overlap: int, room: int) -> str:
    """What of a paragraph opens the next chunk: all of it, its end behind three dots, or nothing."""
    if not overlap or len(paragraph) <= min(overlap, room):
        return paragraph if overlap else ""
    size = min(overlap, len(paragraph), room - 3)
    return "..." + paragraph[-size:] if size > 0 else ""


def chunk_text(text: str, limit: int, overlap: int) -> list[str]:
    """Chunks of whole paragraphs, packed up to ``limit`` characters, each starting with the end of the paragraph before.

    A text within the limit is one chunk as it stands.
    """
    limit = max(1, limit)
    if len(text) <= limit:
        return [text]
    out: list[str] = []
    now: list[str] = []
    before, size = "", -2
    for piece in (x for p in text.split("\n\n") if p.strip() for x in split_long(p, limit)):
        if now and size + 2 + len(piece) > limit:
            out.append("\n\n".join(now).strip())
            tail = overlap_tail(before, overlap, max(0, limit - len(piece) - 2))
            now, size = ([tail], len(tail)) if tail else ([], -2)
        now.append(piece)
        size += 2 + len(piece)
        before = piece
    last = "\n\n".join(now).strip()
    return [*out, last] if last else out


def lines_of(text: str) -> list[str]:
    out = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    return out[:-1] if out and out[-1] == "" else out


def split_code(text: str, limit: int, overlap: int = 3) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of pieces of whole lines of at most ``limit`` bytes, overlapping by some lines.

    A piece has at least one line, however long, and each starts after the one before.
    """
    lines, out, start = lines_of(text), [], 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and (end == start or size + len(lines[end].encode()) + 1 <= limit):
            size += len(lines[end].encode()) + 1
            end += 1
        out.append((start, end - 1, "\n".join(lines[start:end])))
        if end >= len(lines):
            break
        start = max(start + 1, end - overlap)
    return out


def chunks_frame(df: DataFrame, id_col: str, text_col: str, limit: int = 800, overlap: int = 200) -> DataFrame:
    """(item_id, chunk_index, chunk_text) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c) for i, t in zip(pdf["item_id"], pdf["text"], strict=True) for k, c in enumerate(chunk_text(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["item_id", "chunk_index", "chunk_text"])

    slim = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "item_id long, chunk_index int, chunk_text string")
