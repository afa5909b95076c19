"""Ranked keyword search: postings, corpus statistics, phrase and prefix matches, weighted BM25, three tiers.

The statistics (rows, rows per phrase, mean length) are those of all rows of the index; filters come after scoring, so a
status or a date never changes a score. A search needs no index. Plain words are counted in the scan, in two passes
without a shuffle. With stems and word parts one scan, in the JVM, cuts out the words that can hold a stem of the query;
only their different spellings are stemmed, and only rows with such a word go on. ``postings`` and ``bm25`` are the form
for a stored index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tarnstone.functions import text as X
from tarnstone.operators.ordering import first_per, numbered, tiers
from tarnstone.storage import cut


@dataclass(frozen=True)
class Source:
    """What a search needs to know of a record type: key, weighted columns, columns of the substring tier."""

    key: str
    weights: dict[str, float]
    substring: list[str] = field(default_factory=list)

    def like(self) -> list[str]:
        return self.substring or list(self.weights)


def postings(df: DataFrame, source: Source, stems: bool = False) -> DataFrame:
    """(doc, col, pos, term, part): every token of the weighted columns of all rows.

    Plain: words of a-z and 0-9, in the JVM. With stems: words of any script, folded, with their parts, stemmed.
    """
    cols = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in source.weights]))
    long = df.select(F.col(source.key).alias("doc"), cols.alias("x")).select("doc", "x.col", "x.text").where("text IS NOT NULL")
    if not stems:
        return long.select("doc", "col", F.posexplode(X.simple_tokens("text")).alias("pos", "term")).withColumn("part", F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in batches:
            rows = [(d, c, *t) for d, c, x in zip(pdf["doc"], pdf["col"], pdf["text"], strict=True) for t in X.tokens(x, known=known)]
            yield pd.DataFrame(rows, columns=["doc", "col", "pos", "term", "part"])

    return long.mapInPandas(run, "doc long, col string, pos int, term string, part boolean")


def phrases(terms: list[str], stems: bool = False) -> list[list[str]]:
    """The tokens of each query term; a term of several tokens is a phrase. Terms without a token are no phrase."""
    if stems:
        out = [[t for _, t, _ in X.tokens(term, parts=False)] for term in terms]
    else:
        out = [[w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in term).lower().split()] for term in terms]
    return [p for p in out if p]


def phrase_hits(index: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """(doc, col, phrase, hits): occurrences of each phrase, its last token taken as a prefix."""
    out = None
    for no, tokens in enumerate(wanted):
        found = None
        for k, t in enumerate(tokens):
            match = F.startswith("term", F.lit(t)) if k == len(tokens) - 1 else F.col("term") == t
            at = index.where(match).select("doc", "col", (F.col("pos") - k).alias("start")).distinct()
            found = at if found is None else found.join(at, ["doc", "col", "start"])
        part = found.groupBy("doc", "col").agg(F.count("*").alias("hits")).withColumn("phrase", F.lit(no))
        out = part if out is None else out.unionByName(part)
    return out


def bm25(index: DataFrame, rows: DataFrame, wanted: list[list[str]], weights: dict[str, float], every: bool = True) -> DataFrame:
    """(doc, score, phrases): smaller is better; all phrases must match, or any (``every`` false)."""
    n, total = rows.count(), index.where(~F.col("part")).count()
    mean = total / max(1, n)
    hits = phrase_hits(index, wanted)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("col"))
    tf = hits.groupBy("doc", "phrase").agg(F.sum(F.col("hits") * weight).alias("tf"))
    known = {r.phrase: r.n for r in tf.groupBy("phrase").agg(F.count("*").alias("n")).collect()}  # one row a phrase
    idf = F.element_at(F.create_map(*[F.lit(x) for k in range(len(wanted)) for x in (k, float(known.get(k, 0)))]), F.col("phrase"))
    idf = F.greatest(F.log((F.lit(float(n)) - idf + 0.5) / (idf + 0.5)), F.lit(1e-6))
    found = tf.select("doc").distinct()
    length = index.where(~F.col("part")).join(found, "doc", "left_semi").groupBy("doc").agg(F.count("*").alias("len"))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(mean)))
    scored = tf.join(length, "doc").groupBy("doc").agg((-F.sum(part)).alias("score"), F.count("*").alias("phrases"))
    return scored.where(F.col("phrases") == len(wanted)) if every else scored


def _prefix(tokens: list[str]) -> str:
    """Zero-width pattern that matches where a phrase starts: each place is counted once, overlapping ones too."""
    return "(?<![a-z0-9])(?=" + "[^a-z0-9]+".join(tokens) + ")"


def _count(low: Column, tokens: list[str]) -> Column:
    """Occurrences of a phrase; a plain search spares most texts the pattern."""
    has = F.contains(low, F.lit(tokens[0]))
    for t in tokens[1:]:
        has = has & F.contains(low, F.lit(t))
    return F.when(has, F.regexp_count(low, F.lit(_prefix(tokens)))).otherwise(0)


def scan(df: DataFrame, source: Source, wanted: list[list[str]], count: bool = True) -> tuple[DataFrame, list[Column]]:
    """Rows with ``len`` and ``tf0..`` (weighted occurrences of each phrase), and each phrase's part of the score.

    The words are counted where they are read: no token leaves its row. One pass gathers the statistics of all rows (one
    number a phrase), a second one scores.
    """
    low = {c: F.coalesce(X.token_lower(F.col(c).cast("string")), F.lit("")) for c in source.weights}
    length, tf = F.lit(0), [F.lit(0.0)] * len(wanted)
    for c, w in source.weights.items():
        length = length + F.regexp_count(low[c], F.lit("[a-z0-9]+"))
        tf = [t + F.lit(w) * _count(low[c], p) for t, p in zip(tf, wanted, strict=True)]
    rows = df.withColumns({"len": length, **{f"tf{k}": t for k, t in enumerate(tf)}})
    if not count:
        return rows, []
    got = rows.agg(F.count("*").alias("n"), F.sum("len").alias("total"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))]).first()
    n, mean = got["n"], (got["total"] or 0) / max(1, got["n"])
    return rows, [_part(n, got[f"df{k}"], mean, F.col(f"tf{k}")) for k in range(len(wanted))]


def statistics(df: DataFrame, source: Source, wanted: list[list[str]]) -> DataFrame:
    """(phrase, n, mean, df): rows, mean length and rows with each phrase, over the whole index before any filter."""
    rows, _ = scan(df, source, wanted, count=False)
    one = rows.agg(F.count("*").alias("n"), F.sum("len").alias("total"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("phrase"), F.col(f"df{k}").alias("df")) for k in range(len(wanted))]))
    return one.select("n", (F.col("total") / F.col("n")).alias("mean"), each.alias("x")).select("x.phrase", "n", "mean", "x.df").where("df > 0")


def loose_tail(seen: DataFrame, loose: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` any-term hits that no stricter tier has."""
    return loose.join(seen.select("doc"), "doc", "left_anti").orderBy("score", "doc").limit(limit)


def scan_bm25(df: DataFrame, source: Source, wanted: list[list[str]], every: bool = True) -> DataFrame:
    """(doc, score, phrases) as ``bm25``, without an index."""
    rows, parts = scan(df, source, wanted)
    found, score = F.lit(0), F.lit(0.0)
    for k, p in enumerate(parts):
        found, score = found + (F.col(f"tf{k}") > 0).cast("int"), score + p
    scored = rows.select(F.col(source.key).alias("doc"), (-score).alias("score"), found.cast("bigint").alias("phrases"))
    return scored.where(F.col("phrases") == len(wanted) if every else F.col("phrases") > 0)


_SIGN, _GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"


def _head(stem: str) -> str:
    """What every word or part of a word with this stem starts with, in lower case: a stem is a beginning of its words but
    for its last letter."""
    return stem[:-1] if len(stem) > 1 else stem


def holds(words: str, tokens: list[str]) -> bool:
    """Do the words make up the phrase of stems? Its last one may go on."""
    found = re.findall(r"[^\W_]+", words)
    if len(found) != len(tokens):
        return False
    for k, (word, want) in enumerate(zip(found, tokens, strict=True)):
        terms = [t for t, _ in X.word_terms(word, True, True)]
        if not any(t.startswith(want) if k == len(tokens) - 1 else t == want for t in terms):
            return False
    return True


_NO_CELL = "cast(array() as array<struct<k:int,w:double,words:string>>)"


def _rows_of(name: str, df: DataFrame, source: Source, query: str, keep: Column | None) -> DataFrame:
    # one text of SQL a kind: its columns' names come from the source, and each call of a function costs the driver time
    plain = "coalesce(regexp_replace(translate(CAST(`{0}` AS STRING), '" + X.ACCENTED + "', '" + X.PLAIN + "'), '\\\\p{{M}}', ''), '')"
    texts = ", ".join(f"struct({float(w)}D AS w, {plain.format(c)} AS text)" for c, w in source.weights.items())
    kept = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    return df.select(F.lit(name).alias("type"), F.col(source.key).cast("long").alias("doc"), F.expr(f"array({texts})").alias("texts"), substring_hit(source, query).alias("sub"), kept.alias("kept"))


def stem_hits(kinds: list[tuple[str, DataFrame, Source, Column | None]], query: str, strict: list[list[str]], loose: list[list[str]]) -> DataFrame:
    """(type, doc, sub, strict, loose): the kept rows of all kinds with a hit, and their scores.

    One scan in the JVM cuts out the words that can hold a stem and counts the statistics of all rows; only their
    different spellings are stemmed. What is written and joined is the rows with such a word.
    """
    wanted = strict + loose
    rows = None
    for name, df, source, keep in kinds:
        part = _rows_of(name, df, source, query, keep)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("lows", F.transform("texts", lambda t: F.lower(t["text"])))
    cells = F.expr(_NO_CELL)
    for k, tokens in enumerate(wanted):
        heads = [_head(t) for t in tokens]
        word = rf"(?<!{_SIGN})" + _GAP.join(rf"{_SIGN}*?(?i:{re.escape(h)}){_SIGN}*" for h in heads)
        cells = F.concat(cells, F.when(_any_with_all("lows", heads), _cells(k, word)).otherwise(F.expr(_NO_CELL)))
    length = F.aggregate("texts", F.lit(0), lambda n, t: n + F.regexp_count(t["text"], F.lit(_SIGN + "+")))
    seen, names = Observation(), [name for name, *_ in kinds]
    rows = rows.withColumns({"len": length, "found": cells})
    of = lambda name, c: F.sum(F.when(F.col("type") == name, c).otherwise(0))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("all"), *[of(n, F.lit(1)).alias(f"n{k}") for k, n in enumerate(names)], *[of(n, F.col("len")).alias(f"total{k}") for k, n in enumerate(names)])
    rows = cut(rows.where((F.size("found") > 0) | F.col("sub") & F.col("kept")).select("type", "doc", "len", "found", "sub", "kept"), "found")
    long = rows.select("type", "doc", F.explode("found").alias("f")).select("type", "doc", "f.k", "f.w", "f.words").groupBy("type", "doc", "k", "w", "words").agg(F.count("*").alias("hits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[holds(x, wanted[k]) for k, x in zip(pdf["k"], pdf["words"], strict=True)]]

    spelled = rows.select(F.explode(F.transform("found", lambda f: F.struct(f["k"].alias("k"), f["words"].alias("words")))).alias("f")).select("f.k", "f.words").distinct()
    spelled = spelled.mapInPandas(run, "k int, words string")
    every = range(len(wanted))
    hits = long.join(spelled, ["k", "words"]).groupBy("type", "doc").agg(*[F.sum(F.when(F.col("k") == k, F.col("hits") * F.col("w")).otherwise(0.0)).alias(f"tf{k}") for k in every] or [F.lit(0).alias("none")])
    hits = cut(hits, "stems")
    have = {r["type"]: r for r in hits.groupBy("type").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in every]).collect()}  # one row a type
    stats = []
    for at, name in enumerate(names):
        n, total = seen.get[f"n{at}"] or 0, seen.get[f"total{at}"] or 0
        stats.append((name, total / max(1, n) or 1.0, *[_idf(n, have[name][f"df{k}"] if name in have else 0) for k in every]))
    known = rows.sparkSession.createDataFrame(stats, "type string, mean double" + "".join(f", idf{k} double" for k in every))
    out = rows.where("kept").drop("found").join(F.broadcast(known), "type").join(hits, ["type", "doc"], "left").na.fill(0.0, [f"tf{k}" for k in every])
    part = "IF(tf{0} > 0, idf{0} * tf{0} * 2.2D / (tf{0} + 1.2D * (0.25D + 0.75D * len / mean)), 0D)"

    def score(ks: range, joined: str, name: str) -> str:
        if not ks:
            return f"CAST(NULL AS DOUBLE) AS {name}"
        return f"IF({joined.join(f'tf{k} > 0' for k in ks)}, -({' + '.join(part.format(k) for k in ks)}), NULL) AS {name}"

    out = out.selectExpr("type", "doc", "sub", score(range(len(strict)), " AND ", "strict"), score(range(len(strict), len(wanted)), " OR ", "loose"))
    return out.where("sub OR strict IS NOT NULL OR loose IS NOT NULL")


def _any_with_all(lows: str, heads: list[str]) -> Column:
    """Has any of the texts all the heads? A plain search that spares most rows the pattern."""

    def has(low: Column) -> Column:
        out = F.lit(True)
        for h in heads:
            out = out & F.contains(low, F.lit(h))
        return out

    return F.exists(lows, has)


def _cells(k: int, word: str) -> Column:
    """What a row's texts have of a phrase: its number, the weight of the column and the words as they stand."""

    def found(t: Column) -> Column:
        return F.transform(F.regexp_extract_all(t["text"], F.lit(word), F.lit(0)), lambda x: F.struct(F.lit(k).alias("k"), t["w"].alias("w"), x.alias("words")))

    return F.flatten(F.transform("texts", found))


def _idf(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def _part(n: int, df: int, mean: float, tf: Column) -> Column:
    """What a phrase that ``df`` of ``n`` rows have adds to the score of a row."""
    return F.when(tf > 0, F.lit(_idf(n, df)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(mean or 1.0)))).otherwise(0.0)


def substring_hit(source: Source, query: str) -> Column:
    hit = F.lit(False)
    for c in source.like():
        hit = hit | F.coalesce(X.contains_literal(F.col(c).cast("string"), query), F.lit(False))
    return hit


def substring_hits(df: DataFrame, source: Source, query: str) -> DataFrame:
    return df.where(substring_hit(source, query)).select(F.col(source.key).alias("doc"))


def search(df: DataFrame, source: Source, query: str, keep: Column | None = None, stems: bool = False, loose: bool = True) -> DataFrame:
    """(doc, tier, place LONG, score): strict hits by BM25, then substring hits, then at most ten any-term hits.

    ``keep`` filters records after they were scored. An empty query finds nothing. Only the hits of any tier are kept
    for ranking; they are written once.
    """
    if stems:
        return search_all([("", df, source, keep)], query, loose).drop("type")
    spark = df.sparkSession
    if not query.strip():
        return spark.createDataFrame([], "doc long, tier int, place long, score double")
    strict, any_ = phrases(X.sanitize(query)), phrases(X.loose_terms(query) or []) if loose else []
    kept = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    every, n = strict + any_, len(strict)
    total = lambda ps: sum(ps[1:], ps[0])
    rows, parts = scan(df, source, every)
    all_, some = F.lit(bool(n)), F.lit(False)
    for k in range(len(every)):
        has = F.col(f"tf{k}") > 0
        all_, some = (all_ & has, some) if k < n else (all_, some | has)
    hits = rows.where(kept).select(
        F.lit("").alias("type"), F.col(source.key).cast("long").alias("doc"), substring_hit(source, query).alias("sub"),
        (F.when(all_, -total(parts[:n])) if n else F.lit(None).cast("double")).alias("strict"),
        (F.when(some, -total(parts[n:])) if any_ else F.lit(None).cast("double")).alias("loose"),
    ).where("sub OR strict IS NOT NULL OR loose IS NOT NULL")
    return _tiers(hits, bool(any_)).drop("type")


def search_all(kinds: list[tuple[str, DataFrame, Source, Column | None]], query: str, loose: bool = True) -> DataFrame:
    """(type, doc, tier, place, score): ``search`` with stems over several kinds (name, rows, source, keep) at once, each
    with its own statistics and places."""
    if not query.strip():
        return kinds[0][1].sparkSession.createDataFrame([], "type string, doc long, tier int, place long, score double")
    strict, any_ = phrases(X.sanitize(query), True), phrases(X.loose_terms(query) or [], True) if loose else []
    return _tiers(stem_hits(kinds, query, strict, any_), bool(any_))


def _tiers(hits: DataFrame, loose: bool) -> DataFrame:
    """Hits (type, doc, sub, strict, loose) in tiers; each type has places of its own."""
    hits = cut(hits, "hits")
    rows = hits.count()
    first = numbered(hits.where("strict IS NOT NULL").select("type", "doc", F.col("strict").alias("score")), "score", "doc", by="type", rows=rows)
    second = numbered(hits.where("sub").select("type", "doc", F.lit(None).cast("double").alias("score")), "doc", by="type", rows=rows)
    found = tiers([first, second], ["type", "doc"])
    if loose:
        rest = hits.where("strict IS NULL AND NOT sub AND loose IS NOT NULL").select("type", "doc", F.col("loose").alias("score"))
        rest = first_per(rest, ["type"], F.col("score"), F.col("doc"), n=X.LOOSE_LIMIT, rank="place").withColumn("place", F.col("place").cast("long"))
        found = found.unionByName(rest.withColumn("tier", F.lit(2)))
    return found.select("type", "doc", "tier", "place", "score")


def index_check(stored: DataFrame, df: DataFrame, source: Source) -> DataFrame:
    """(missing, extra): how the stored postings differ from the records they were made from."""
    now = postings(df, source).select("doc", "col", "pos", "term")
    old = stored.select("doc", "col", "pos", "term")
    missing, extra = now.exceptAll(old).agg(F.count("*").alias("missing")), old.exceptAll(now).agg(F.count("*").alias("extra"))
    return missing.crossJoin(extra)  # one row each
