"""Variant spellings of names typed by people (problem 1).

1. Parse. A name is brought to (first, last) tokens: titles, notes in brackets, legal forms and notation are removed,
   accents folded; "Last, First", "LAST First", "FirstLast", initials and addresses in place of a name are understood.
2. Block. Records meet if they share a usable address or handle, or the phonetic code of their tokens: the code
   of the last name, with each of its single deletions (so one slip in it still meets), with the initial of the first;
   and the sorted codes of both, with the same deletions, so that the order of the parts doesn't matter.
3. Compare. Last names by edit distance and Jaro-Winkler on their phonetic codes, first names by a nickname table,
   initials and Jaro-Winkler.
4. Cluster. Accepted pairs become connected components, in two steps: what shares a contact and a compatible name first;
   then names alone, where groups whose contacts contradict each other (namesakes) are never joined, and a record that
   would fit several such groups goes to the one it fits best.

A contact most of whose rows have a surname that fits neither its commonest one nor the address (a list address, a
filler) identifies nobody and is dropped; this is counted over all rows. Equal records are compared once. Blocks of any size are spread over a grid of tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.llm.components import connected_components
from tarnstone.llm.near import all_pairs, cells
from tarnstone.storage import cut

# Common short forms of first names.
NICKNAMES = {
    "alex": "alexander aleksandra alexandra", "sandy": "alexander aleksandra alexandra", "sasha": "alexander aleksandra alexandra",
    "xander": "alexander", "ola": "aleksandra", "tony": "anthony", "ant": "anthony", "andy": "andrew andre", "ben": "benjamin", "benny": "benjamin",
    "charlie": "charles", "chuck": "charles", "chas": "charles", "chris": "christopher christine", "kit": "christopher", "topher": "christopher",
    "dot": "dorothy", "dolly": "dorothy", "dottie": "dorothy", "ed": "edward edgar", "eddie": "edward edgar", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth", "bess": "elizabeth",
    "manu": "emmanuel", "manny": "emmanuel", "paco": "francisco", "pancho": "francisco", "fran": "francisco", "kiko": "francisco", "frank": "francisco",
    "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "rick": "frederick richard", "gabi": "gabriela", "gaby": "gabriela",
    "isa": "isabella", "bella": "isabella", "izzy": "isabella", "jenny": "jennifer", "jen": "jennifer", "jenn": "jennifer",
    "hannes": "johannes", "hans": "johannes", "johann": "johannes", "pepe": "jose", "jo": "josephine", "josie": "josephine", "josy": "josephine",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kitty": "katherine", "leo": "leonie",
    "meg": "margaret", "maggie": "margaret", "peggy": "margaret", "greta": "margaret", "marge": "margaret", "mike": "michael", "mick": "michael", "mickey": "michael",
    "nick": "nicholas", "nicky": "nicholas", "klaus": "nicholas", "nomi": "noemi", "dick": "richard", "rich": "richard", "ricky": "richard",
    "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert", "sam": "samuel", "sammy": "samuel",
    "steve": "stephen", "steph": "stephen", "susi": "susanne", "sue": "susanne", "susie": "susanne", "susan": "susanne", "theo": "theodore", "toby": "tobias", "tobi": "tobias",
    "vicky": "victoria", "tori": "victoria", "vic": "victoria", "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william",
    "zo": "zoe zofia", "zosia": "zofia",
}
# Titles, legal forms and words of trade.
TITLES = {"dr", "prof", "eng", "mx", "mr", "mrs", "ms", "miss", "ing", "dipl", "phd", "sir", "herr", "frau"}
LEGAL = {"corp", "corporation", "inc", "incorporated", "ltd", "limited", "co", "company", "gmbh", "llc", "plc", "ag", "sa", "kg", "gesellschaft", "mit", "beschrankter", "haftung", "the", "and", "und"}
TRADES = {"instruments", "optics", "translations", "legal", "catering", "analytics", "seed", "trading", "freight", "print", "works", "data", "services", "consulting", "systems", "foods", "labs", "studio", "media", "partners", "group", "foundation", "institute", "software", "logistics", "design"}
MAILBOXES = {"info", "sales", "office", "hello", "billing", "contact", "admin", "support", "mail", "team", "hr", "press", "accounts"}
FILLERS = {"", "-", "?", "n/a", "na", "none", "null", "unknown", "ghost", "tbd", "x", "nil", "none@none.example"}
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_ALIKE, _TWICE = str.maketrans("yzwcqj", "isvkki"), re.compile(r"(.)\1+")
_MAIL = re.compile(r"[\w.+'-]+@[\w-]+(?:\.[\w-]+)+")
#: Words and pairs of words whose results a worker keeps; names repeat.
CACHE = 1 << 16
PARSED = "id long, org boolean, first string, last string, mail string, grade int, handle string"
#: Grades of an address: only made of the person's name; with a number of its own; made otherwise.
PLAIN, NUMBERED, ODD = 1, 2, 3
#: Named rows of a contact from which it can count as shared by strangers, and the share of them that must fit its name.
SHARED_ROWS, SHARED_FIT = 3, 0.5


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.lower().translate(_PLAIN))
    return "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf")).translate(_PLAIN)


def mail_key(text: str | None) -> str | None:
    """The address without decoration; for a mailbox of an organisation its domain."""
    if not isinstance(text, str):
        return None
    m = _MAIL.search(fold(text).replace("mailto:", ""))
    if not m or m[0] in FILLERS:
        return None
    local, _, domain = m[0].partition("@")
    local = local.partition("+")[0]
    return f"@{domain}" if local in MAILBOXES else f"{local}@{domain}"


def handle_key(text: str | None) -> str | None:
    if not isinstance(text, str):
        return None
    whole = fold(text).strip()
    h = whole.rstrip("/").rpartition("/")[2].lstrip("@").strip()
    return None if whole in FILLERS or h in FILLERS else h


def mail_grade(mail: str, org: bool, first: str, last: str) -> int:
    """What an address says against other addresses of the same name.

    One made of the name alone (a.last, first.last, lasta ..) may be the same person elsewhere; one with a number, or made
    in another way, was given to tell people apart.
    """
    local, last = mail.partition("@")[0], last.replace("-", "")
    if org or not local:
        return NUMBERED
    letters, numbered = re.sub(r"[^a-z]", "", local), any(c.isdigit() for c in local)
    firsts = [first, *NICKNAMES.get(first, "").split()]
    if len(last) < 3:
        odd = False
    elif last in letters:
        rest = letters.replace(last, "", 1)
        odd = bool(rest) and not any(f[:1] == rest or len(rest) > 2 and distance(rest, f) <= 1 for f in firsts) and not (len(first) == 1 and rest[0] == first)
    else:
        odd = min(distance(letters, x) for f in firsts for x in (f + last, f[:1] + last, last + f[:1])) > 2
    return ODD if odd else NUMBERED if numbered else PLAIN


@lru_cache(CACHE)
def parse_name(name: str | None) -> tuple[bool, str, str]:
    """(organisation?, first, last); an unknown part is empty, one that is only an initial has one letter."""
    if not isinstance(name, str) or not name.strip():
        return False, "", ""
    if "@" in name:
        return False, "", ""
    text = re.sub(r"[\(\[].*?[\)\]]", " ", unicodedata.normalize("NFKC", name))
    text = re.split(r"\s[-–—|/]\s", text)[0].replace("’", "'").strip()
    flat = re.sub(r"\bg\.?\s?m\.?\s?b\.?\s?h\b\.?", "gmbh", fold(text))
    words = re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", flat)
    if any(w in LEGAL for w in words) or "&" in text or (words and words[-1] in TRADES):
        core = [w for w in words if w not in LEGAL]
        names = [w for w in core if w not in TRADES] or core
        return True, " ".join(w for w in core if w in TRADES and w not in names), " ".join(names)
    if "," in text:
        a, _, b = text.partition(",")
        last, rest = re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", fold(a)), re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", fold(b))
        rest = [w for w in rest if w not in TITLES]
        return False, rest[0] if rest else "", last[-1] if last else ""
    raw = re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", text)
    raw = [w for w in raw if fold(w) not in TITLES]
    if len(raw) == 1:
        glued = re.match(r"^([^\W\d_a-z]?[^\W\d_A-Z]+)([^\W\d_a-z].+)$", raw[0])
        if glued and raw[0] != raw[0].upper() and "-" not in glued[1]:
            raw = [glued[1], glued[2]]
    if not raw:
        return False, "", ""
    if len(raw) == 1:
        return False, "", fold(raw[0])
    capital = [w for w in raw if len(w) > 1 and w == w.upper() and w != w.lower()]
    if capital and len(capital) < len(raw) and capital[0] == raw[0]:
        return False, fold(raw[1]), fold(raw[0])
    return False, fold(raw[0]), fold(raw[-1])


@lru_cache(CACHE)
def phonetic(word: str) -> str:
    """Letters that sound alike made one: a code that keeps vowels, for names of any language."""
    for a, b in (("ph", "f"), ("ck", "k"), ("th", "t"), ("qu", "kv"), ("sch", "s"), ("sh", "s")):
        word = word.replace(a, b)
    return _TWICE.sub(r"\1", word.translate(_ALIKE))


@lru_cache(CACHE)
def distance(a: str, b: str, limit: int = 3) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two words, or ``limit`` if there are as many."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) >= limit:
        return limit
    spare = sum(max(0, a.count(c) - b.count(c)) for c in set(a))  # letters of a that b lacks: each costs an edit
    if max(spare, spare + len(b) - len(a)) >= limit:
        return limit
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(row[-1], limit)


@lru_cache(CACHE)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, xs = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                xs.append(x)
                break
    if not xs:
        return 0.0
    ys = [y for y, u in zip(b, used, strict=True) if u]
    m, t = len(xs), sum(x != y for x, y in zip(xs, ys, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@lru_cache(CACHE)
def first_score(a: str, b: str) -> float:
    """1 equal, 0.9 nickname, 0.85 slip, 0.6 initial, 0.5 unknown, 0 different."""
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        short, long = sorted((a, b), key=len)
        return 0.6 if long[0] == short or any(full[0] == short for full in NICKNAMES.get(long, "").split()) else 0.0
    x, y = NICKNAMES.get(a, a).split() + [a], NICKNAMES.get(b, b).split() + [b]
    if set(x) & set(y):
        return 0.9
    near = lambda p, q: p[0] == q[0] and min(distance(p, q), distance(phonetic(p), phonetic(q))) <= 1
    best = max((max(jaro_winkler(p, q), jaro_winkler(phonetic(p), phonetic(q))) if near(p, q) else 0.0) for p in x for q in y)
    return 0.85 if best >= 0.8 else 0.0


@lru_cache(CACHE)
def last_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.5
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a[0] == b[0] else 0.0
    if ("-" in a) != ("-" in b):  # one of the two parts of a double name may be left out
        parts, other = (a.split("-"), b) if "-" in a else (b.split("-"), a)
        found = max(last_score(x, other) if len(x) > 3 else 0.0 for x in parts)
        if found:
            return 0.9 * found
    a, b = a.replace("-", ""), b.replace("-", "")
    p, q = phonetic(a), phonetic(b)
    if p == q:
        return 1.0
    d = min(distance(p, q), distance(a, b))
    if d <= 1 and min(len(p), len(q)) >= 5 or d == 2 and min(len(p), len(q)) >= 9 and p[:2] == q[:2]:
        return jaro_winkler(p, q)
    return 0.0


def name_score(org: bool, first: str, last: str, org2: bool, first2: str, last2: str) -> float:
    """How well two parsed names fit: 0 not at all; above 0.8 a full match; below, an initial or a part is missing."""
    if (org != org2) and last and last2:
        return 0.0
    if org and org2:
        a, b = last.split(), last2.split()
        if first != first2 or len(a) != len(b):
            return 0.0
        return min((last_score(x, y) for x, y in zip(a, b, strict=True)), default=0.0)
    f, s = first_score(first, first2), last_score(last, last2)
    if f == 0 or s == 0:
        # one of the two may have the parts in the other order; both must be there and fit
        if org or org2 or min(len(first), len(last), len(first2), len(last2)) < 2:
            return 0.0
        if (first, last) == (last2, first2):
            return 0.9
        if min(len(first), len(last), len(first2), len(last2)) < 3:
            return 0.0
        f, s = min(first_score(first, last2), first_score(last2, first)), last_score(last, first2)
        return 0.0 if f < 0.85 or s == 0 else f * s
    return f * s


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, name, mail, handle in pdf.itertuples(index=False):
            org, first, last = parse_name(name)
            m = mail_key(mail) or (mail_key(name) if isinstance(name, str) and "@" in name else None)
            rows.append((i, org, first, last, m, mail_grade(m, org, first, last) if m else 0, handle_key(handle)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows ``n`` of a contact and name if the name may be its owner's: ``top``, the commonest, or in the address."""
    for pdf in batches:
        rows = []
        for contact, first, last, top, n, total in pdf.itertuples(index=False):
            local = re.sub(r"[^a-z]", "", contact.partition("@")[0])
            ok = len(last) > 3 and last in local or any(len(x) > 1 and (last_score(x, top) > 0 or jaro_winkler(x, top) >= 0.88) for x in (last, first))
            rows.append((contact, n if ok else 0, total))
        yield pd.DataFrame(rows, columns=["contact", "fit", "all"])


def parsed_people(people: DataFrame) -> DataFrame:
    """One row per record: see ``PARSED``. Shared contacts are null already."""
    rows = cut(
        people.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in ("name", "email", "github_username")]).mapInPandas(_parse, PARSED),
        "people",
    )
    out = rows
    for c in ("mail", "handle"):
        use = rows.where(F.col(c).isNotNull() & (F.length("last") > 1)).groupBy(F.col(c).alias("contact"), "first", "last").agg(F.count("*").alias("n"))
        names = use.groupBy("contact", "last").agg(F.sum("n").alias("n"))
        top = names.groupBy("contact").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.contains("contact", "last").alias("within"), "last"))["last"].alias("top"))
        fit = use.join(top.where(F.col("all") >= SHARED_ROWS), "contact").select("contact", "first", "last", "top", "n", "all").mapInPandas(_fit, "contact string, fit long, all long")
        bad = fit.groupBy("contact", "all").agg(F.sum("fit").alias("fit")).where(F.col("fit") < SHARED_FIT * F.col("all")).select(F.col("contact").alias(c), F.lit(True).alias("shared"))
        out = out.join(bad, c, "left").withColumn(c, F.when(F.col("shared").isNull(), F.col(c))).drop("shared")
    return out.select(*[c.split()[0] for c in PARSED.split(", ")])


@lru_cache(CACHE)
def slips(code: str) -> tuple[str, ...]:
    """A code and what is left of it without one of its letters."""
    return (code, *{code[:k] + code[k + 1 :] for k in range(len(code))})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            keys = set()
            if r.mail:
                keys.add("m" + r.mail)
            if r.handle:
                keys.add("h" + r.handle)
            if len(r.last) > 1:
                codes = {phonetic(re.sub(r"[\s-]", "", r.last)), *(phonetic(x) for x in r.last.split("-") if "-" in r.last and len(x) > 3)}
                if r.org:
                    marks = ["#" + r.first]
                else:
                    marks = {f[0] for f in [*NICKNAMES.get(r.first, "").split(), r.first] if f} or {"?"}
                # a name of two letters has no slip that leaves it recognisable
                for form in {f for code in codes for f in (slips(code) if len(code) > 2 else (code,))}:
                    keys.update([f"n{form} {m}" for m in marks])
                if not r.org and len(r.first) > 1:
                    first, last = phonetic(r.first), phonetic(r.last.replace("-", ""))
                    both = [(f, last) for f in slips(first)] + [(first, f) for f in slips(last)] if min(len(r.first), len(r.last)) > 2 else [(first, last)]
                    keys.update([f"s{a} {b}" if a <= b else f"s{b} {a}" for a, b in both])
            rows += [(k, r.cid) for k in keys]
        yield pd.DataFrame(rows, columns=["sig", "cid"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for r in pdf.itertuples(index=False):
            s = name_score(r.org, r.first, r.last, r.org2, r.first2, r.last2)
            if s == 0 and r.contact and r.org == r.org2 and r.first[:1] == r.first2[:1] and jaro_winkler(r.last, r.last2) >= 0.88:
                s = 0.5  # the same contact bears out a name with several slips
            if s > 0:
                keep.append((r.lo, r.hi, r.contact, s))
        yield pd.DataFrame(keep, columns=["lo", "hi", "contact", "score"])


def meeting_ids(rows: DataFrame) -> DataFrame:
    """(lo, hi), distinct: the pairs of rows (sig, cid, cell, side) that share sig and cell; of a split sig (side not 0) only
    pairs of different sides. The rows of a sig are streamed in order and met at growing distance: no row of a sig of its
    own is joined with anything."""

    def met(sig: np.ndarray, cell: np.ndarray, cid: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, size, d, last = [], 0, 1, len(sig) - 1
        i = np.flatnonzero((sig[1:] == sig[:-1]) & (cell[1:] == cell[:-1]))
        while len(i):
            keep = (cid[i] != cid[i + d]) & ((side[i] == 0) | (side[i] != side[i + d]))
            p, q = cid[i[keep]], cid[i[keep] + d]
            out.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
            size, d = size + len(p), d + 1
            i = i[i + d <= last]
            i = i[(sig[i + d] == sig[i]) & (cell[i + d] == cell[i])]
            if size and (size >= 1 << 20 or not len(i)):  # a block of any size is given away in parts
                got = np.unique(np.concatenate(out, axis=1), axis=1)
                out, size = [], 0
                for lo in range(0, got.shape[1], 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 18)]) for c in got], names=["lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            if not final:  # the rows of the last sig may go on in the next batch
                other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
                stop = other[-1] + 1 if len(other) else 0
                held.append([c[stop:] for c in cols])
                cols = [c[:stop] for c in cols]
            if len(cols[0]) > 1:
                yield from met(*cols)

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= 1 << 18 and (held[0][0][0] != held[-1][0][-1] or held[0][1][0] != held[-1][1][-1]):
                yield from flush(False)
        if held:
            yield from flush(True)

    near = rows.select("sig", "cell", "cid", "side").repartition("sig", "cell").sortWithinPartitions("sig", "cell")
    return near.mapInArrow(run, "lo long, hi long").distinct()


def scored_pairs(records: DataFrame, hot_rows: int = 20_000) -> DataFrame:
    """(lo, hi, contact, score) of the distinct records (cid, org, first, last, mail, handle) that share a block."""
    keys = records.select("cid", "org", "first", "last", "mail", "handle").mapInPandas(_keys, "sig string, cid long")
    keys = cut(keys.select(F.xxhash64("sig").alias("sig"), "cid"), "keys")  # another name under the same number is compared in vain
    pairs = cut(meeting_ids(cells(keys, hot_rows)), "pairs")
    x = records.select(F.col("cid").alias("lo"), "org", "first", "last", "mail", "handle")
    y = records.select(F.col("cid").alias("hi"), *[F.col(c).alias(c + "2") for c in ("org", "first", "last", "mail", "handle")])
    both = pairs.join(x, "lo").join(y, "hi").withColumn("contact", F.coalesce((F.col("mail") == F.col("mail2")) | (F.col("handle") == F.col("handle2")), F.coalesce(F.col("mail") == F.col("mail2"), F.col("handle") == F.col("handle2")), F.lit(False)))
    return both.select("lo", "hi", "contact", "org", "first", "last", "org2", "first2", "last2").mapInPandas(_compare, "lo long, hi long, contact boolean, score double")


def link_people(people: DataFrame, hot_rows: int = 20_000) -> DataFrame:
    """(id, entity): the smallest id of the person or organisation of every record that has a variant.

    Records whose name and contacts are all null or unusable stay alone and are left out. Rows that are equal after
    parsing and have a contact or a full name are variants of each other.
    """
    rows = cut(parsed_people(people), "parsed")
    fields = ["org", "first", "last", "mail", "grade", "handle"]
    tag = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in fields])
    usable = F.col("mail").isNotNull() | F.col("handle").isNotNull() | ((F.length("last") > 1) & (F.length("first") > 0))
    rows = rows.where(usable).withColumn("tag", tag)
    records = cut(rows.groupBy("tag", *fields).agg(F.min("id").alias("cid"), F.count("*").alias("n")), "records")
    pairs = cut(scored_pairs(records.drop("tag", "n", "grade"), hot_rows), "scored")

    strong = connected_components(pairs.where("contact"), "lo", "hi").select(F.col("vertex").alias("cid"), "component")
    at = records.join(strong, "cid", "left").select("cid", F.coalesce("component", "cid").alias("g"), "mail", "grade", "handle", "n")
    at = cut(at, "groups")
    # bits: 1 a handle, 2 an address that tells people apart, 4 an odd one, 8 any address
    graded = F.when(F.col("mail").isNull(), 0).when(F.col("grade") == PLAIN, 8).when(F.col("grade") == NUMBERED, 10).otherwise(14)
    kinds = at.groupBy("g").agg(F.bit_or(F.col("handle").isNotNull().cast("int").bitwiseOR(graded)).alias("kind"), F.sum("n").alias("size"))

    side = at.select("cid", "g").join(kinds, "g")
    lo, hi = [side.select(F.col("cid").alias(c), *[F.col(x).alias(x + k) for x in ("g", "kind", "size")]) for c, k in (("lo", "1"), ("hi", "2"))]
    agree = "(kind1 & kind2 & 3) = 0 AND NOT (((kind1 | kind2) & 4) = 4 AND (kind1 & kind2 & 8) = 8)"
    soft = pairs.where("score >= 0.5").join(lo, "lo").join(hi, "hi").where(f"g1 <> g2 AND {agree}")
    flip = soft.select("g1", "kind1", "size1", "g2", "kind2", "size2", "score").unionByName(
        soft.select(F.col("g2").alias("g1"), F.col("kind2").alias("kind1"), F.col("size2").alias("size1"), F.col("g1").alias("g2"), F.col("kind1").alias("kind2"), F.col("size1").alias("size2"), "score")
    )
    flip = cut(flip.groupBy("g1", "kind1", "size1", "g2", "kind2", "size2").agg(F.max("score").alias("score")), "soft")
    # a group that nothing tells apart goes to the best group with a contact; one with a contact of its own must be
    # that group's best as well
    rank = lambda by, *o: F.row_number().over(Window.partitionBy(by).orderBy(*o))
    best = flip.where("kind2 > 0").withColumn("p", rank("g1", F.col("score").desc(), F.col("size2").desc(), "g2")).where("p = 1")
    loose = best.where("(kind1 & 3) = 0").select("g1", "g2")
    half = flip.where("(kind1 & 3) > 0 AND (kind2 & 3) > 0").withColumn("p", rank("g1", F.col("score").desc(), F.col("size2").desc(), "g2")).where("p = 1")
    mutual = half.alias("x").join(half.alias("y"), F.expr("x.g1 = y.g2 AND x.g2 = y.g1")).select(F.col("x.g1").alias("g1"), F.col("x.g2").alias("g2"))
    bare = flip.where("kind1 = 0 AND kind2 = 0").join(loose.select("g1"), "g1", "left_anti").join(loose.select(F.col("g1").alias("g2")), "g2", "left_anti").where("score >= 0.7").select("g1", "g2")
    links = loose.unionByName(mutual).unionByName(bare).select(F.col("g1").alias("u"), F.col("g2").alias("v"))
    whole = connected_components(links, "u", "v").select(F.col("vertex").alias("g"), F.col("component").alias("top"))
    entity = at.select("cid", "g").join(whole, "g", "left").select("cid", F.coalesce("top", "g").alias("entity"))
    named = rows.join(records.select("tag", "cid"), "tag").join(entity, "cid").select("id", "entity")
    size = named.groupBy("entity").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    return named.join(size.where("size > 1"), "entity").select("id", F.col("least").alias("entity"))


def variant_pairs(people: DataFrame) -> DataFrame:
    """(lo_id, hi_id): all pairs of records of one person or organisation."""
    e = cut(link_people(people), "entities")
    return all_pairs(e.select(F.col("entity").alias("sig"), F.col("id").alias("cid"))).select(F.col("x").alias("lo_id"), F.col("y").alias("hi_id"))
