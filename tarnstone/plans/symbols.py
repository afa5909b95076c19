"""Code without a grammar: definitions, calls, call graphs by name, and ranked search over symbols, lines and chunks.

Everything is a scan of the files' lines; definitions and calls are found by the written form that the known languages
share. A symbol's key is its file's key and its line, so it is the same wherever it is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.functions import text as X
from tarnstone.plans.code import lines, match_class
from tarnstone.sources.readers import language
from tarnstone.storage import cut

#: A line that opens a definition: its kind and its name.
DEFINITION = r"^\s*(?:pub(?:\([a-z]+\))?\s+|export\s+(?:default\s+)?|async\s+)*(fn|def|class|function|func|struct|enum|trait|interface|impl)\s+([A-Za-z_][A-Za-z0-9_]*)"
CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("
#: Names before a bracket that tell nothing about the callers: words of the languages and of their standard libraries.
NOISE = ("if", "for", "while", "match", "return", "switch", "catch", "fn", "def", "class", "function", "func", "impl", "len", "range", "print", "println", "Ok", "Err", "Some", "into", "unwrap", "clone", "map", "filter", "format", "ValueError", "info", "warn", "error")
LINE_KEYS = 100_000


def code_lines(chunks: DataFrame) -> DataFrame:
    """(id, repo_id, file_path, last_modified, n, line) of the chunks in a language that has definitions."""
    lang = language(F.col("file_path"))
    code = chunks.where(F.col("chunk_text").isNotNull() & lang.isNotNull() & (lang != "markdown"))
    return lines(code, ["id", "repo_id", "file_path", "last_modified"], "chunk_text").withColumnRenamed("line_no", "n")


def symbols(chunks: DataFrame, holding: list[str] | None = None) -> DataFrame:
    """(symbol, id, repo_id, file_path, last_modified, n, kind, name, signature) of every definition.

    ``holding``: only of files that have one of these texts, in any case; the others are not cut into lines.
    """
    if holding:
        has = F.lit(False)
        for t in holding:
            has = has | F.contains(F.lower("chunk_text"), F.lit(t.lower()))
        chunks = chunks.where(has)
    found = code_lines(chunks).withColumns({"kind": F.regexp_extract("line", DEFINITION, 1), "name": F.regexp_extract("line", DEFINITION, 2)}).where("name <> ''")
    return found.select((F.col("id") * LINE_KEYS + F.col("n")).alias("symbol"), "id", "repo_id", "file_path", "last_modified", "n", "kind", "name", X.signature(F.trim("line")).alias("signature"))


def calls(chunks: DataFrame, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """(symbol, caller, to_name), each once: what the body of a definition calls.

    The caller of a line is the last definition above it in its chunk; calls before the first have none and are left
    out, as are calls of noise and of the caller itself on its own line.
    """
    l = code_lines(chunks).withColumn("name", F.nullif(F.regexp_extract("line", DEFINITION, 2), F.lit("")))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = l.withColumns({
        "caller": F.last("name", ignorenulls=True).over(w),
        "at": F.last(F.when(F.col("name").isNotNull(), F.col("n")), ignorenulls=True).over(w),
    }).where("caller IS NOT NULL")
    names = F.array_distinct(F.expr(f"regexp_extract_all(line, '{CALL}', 1)".replace("\\", "\\\\")))
    out = owned.select((F.col("id") * LINE_KEYS + F.col("at")).alias("symbol"), "caller", "name", F.explode(names).alias("to_name"))
    return out.where(~F.col("to_name").isin(*noise) & (F.col("name").isNull() | (F.col("name") != F.col("to_name")))).select("symbol", "caller", "to_name").distinct()


def resolved(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with ``target``: the last symbol of the callee's name in the caller's file; null where it has none."""
    home = known.select("symbol", "repo_id", "file_path")
    last = known.groupBy("repo_id", "file_path", F.col("name").alias("to_name")).agg(F.max("symbol").alias("target"))
    return edges.join(home, "symbol").join(last, ["repo_id", "file_path", "to_name"], "left").select("symbol", "caller", "to_name", "target")


def graph_of_names(edges: DataFrame, known: DataFrame, seed: str, max_depth: int) -> DataFrame:
    """(name, depth, known): breadth-first by name from ``seed``; a name without a symbol is a leaf.

    Edges of all symbols of a name are followed. One join of the frontier a level; only names are exchanged.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.col("caller").alias("name"), "to_name").distinct(), "graph")
    defined = cut(known.select("name").distinct(), "names")
    seen = cut(spark.createDataFrame([(seed, 0)], "name string, depth int"), "seen")
    for depth in range(1, max_depth + 1):
        front = seen.where(F.col("depth") == depth - 1).select("name")
        new = e.join(front, "name").select(F.col("to_name").alias("name")).distinct().join(seen.select("name"), "name", "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)), "seen")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen.join(defined.withColumn("known", F.lit(True)), "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _has(c: str, term: str) -> Column:
    return F.coalesce(X.contains_literal(c, term), F.lit(False))


def symbol_hits(known: DataFrame, query: str, limit: int = X.LOOSE_LIMIT) -> DataFrame:
    """(symbol, name, whole, terms, class): symbols that hold the whole query, and of each repo the best few that hold
    some of its words only."""
    terms = X.code_terms(query)
    cols = {"whole": _has("name", query) | _has("signature", query), "terms": F.lit(0), "in_name": F.lit(0)}
    for t in terms:
        cols["terms"] = cols["terms"] + (_has("name", t) | _has("signature", t)).cast("int")
        cols["in_name"] = cols["in_name"] + _has("name", t).cast("int")
    k = known.withColumns(cols).where("whole OR terms > 0")
    whole = k.where("whole").withColumn("class", match_class(F.col("name"), query))
    w = Window.partitionBy("repo_id").orderBy(F.col("terms").desc(), F.col("in_name").desc(), "name", "symbol")
    some = k.where("NOT whole").withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= limit).drop("_p").withColumn("class", F.lit(4))
    return whole.unionByName(some)


def line_hits(chunks: DataFrame, query: str, limit: int, few: int = X.LOOSE_LIMIT) -> DataFrame:
    """(id, repo_id, n, line, phrase, whole, terms): of each repo up to ``limit`` lines with every term of the query,
    those with the whole phrase first, and a few with only some of its words."""
    every = [t.lower() for t in query.split()]
    some = X.code_terms(query)
    low = F.lower("line")
    all_, n = F.lit(bool(every)), F.lit(0)
    for t in every:
        all_ = all_ & F.contains(low, F.lit(t))
    for t in some:
        n = n + F.contains(low, F.lit(t)).cast("int")
    body = F.lower("chunk_text")
    any_ = F.lit(False)
    for t in dict.fromkeys([*every, *some]):
        any_ = any_ | F.contains(body, F.lit(t))  # spares most files the cutting into lines
    l = lines(chunks.where(any_), ["id", "repo_id"], "chunk_text").withColumnRenamed("line_no", "n")
    l = l.withColumns({"whole": all_, "terms": n, "phrase": F.contains(low, F.lit(" ".join(every)))}).where("whole OR terms > 0")
    order = [F.col("phrase").desc(), F.col("terms").desc(), "id", "n"]
    w = Window.partitionBy("repo_id", "whole").orderBy(*order)
    return l.withColumn("_p", F.row_number().over(w)).where((F.col("whole") & (F.col("_p") <= limit)) | (~F.col("whole") & (F.col("_p") <= few))).drop("_p")


def code_rank(hits: DataFrame, phrase: Column, cls: Column, ties: list[str], limit: int, few: int = X.LOOSE_LIMIT) -> DataFrame:
    """The best ``limit`` of all repos, in order: whole hits by phrase and class, then at most ``few`` others by terms."""
    rows = cut(hits.withColumns({"_phrase": phrase.cast("int"), "_class": cls}), "code")  # a few of each repo, read twice
    whole = rows.where("whole").orderBy(F.col("_phrase").desc(), "_class", *ties).limit(limit)
    some = rows.where("NOT whole").orderBy(F.col("terms").desc(), "_class", *ties).limit(few)
    both = whole.unionByName(some)
    one = Window.partitionBy(F.lit(0)).orderBy(F.col("whole").desc(), F.when(F.col("whole"), -F.col("_phrase")).otherwise(-F.col("terms")), "_class", *ties)
    # at most limit + few rows are left
    return both.withColumn("place", F.row_number().over(one)).where(F.col("place") <= limit).drop("_phrase", "_class")
