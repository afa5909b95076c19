"""Snippets, lines and sections that a reader sees, and the session context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.functions import text as X


def snippet(text: Column, query: str, words: int = 20) -> Column:
    """About ``words`` words around the first match of a query word; null without a match."""
    flat = X.squeeze(text)
    first = F.array(*[F.lit(t.lower()) for t in query.split()])
    parts = F.split(flat, " ")
    hit = F.array_position(F.transform(parts, lambda w: F.exists(first, lambda q: F.startswith(F.regexp_replace(X.ascii_lower(w), "^[^a-z0-9]+", ""), q))), True)
    start = F.greatest(hit.cast("int") - words // 3, F.lit(1))
    return F.when(hit > 0, F.array_join(F.slice(parts, start, F.lit(words)), " "))


class _WordTerms:
    """Table function: (pos, term, part) of a text, by the tokenizer of the keyword index."""

    def eval(self, text: str, parts: bool, stems: bool):
        for pos, term, part in X.tokens(text, parts=parts, stems=stems) if text else ():
            yield pos, term, part


def register(spark) -> None:
    """Makes the tokenizer (``word_terms``) and the vector distance (``vec_distance_cosine``) known to SQL.

    The distance is a function of SQL itself: the planner puts its expression in place, no Python runs.
    """
    spark.udtf.register("word_terms", F.udtf(_WordTerms, returnType="pos int, term string, part boolean"))
    dot = "aggregate(zip_with({0}, {1}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), 0D, (s, v) -> s + v)"
    norm = f"sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vec_distance_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE "
        f"RETURN CASE WHEN size(a) = size(b) AND {norm} > 0 AND {norm} < double('Infinity') THEN 1 - {dot.format('a', 'b')} / ({norm}) END"
    )


def keyword_snippet(text: Column, query: str, n: int = 120) -> Column:
    """The snippet, else the excerpt around the query, else the head."""
    return F.coalesce(snippet(text, query), F.when(X.contains_literal(text, query), X.excerpt(text, query, n)), X.truncate(text, n))


def hit_line(place: Column, kind: Column, name: Column, score: Column) -> Column:
    """One line per hit, as it is counted against a token budget."""
    return F.concat(F.format_string("%2d. ", place), F.rpad(kind, 12, " "), name, F.when(score.isNotNull(), F.format_string(" (%.2f)", score)).otherwise(F.lit("")))


def labelled(fields: list[tuple[str, Column]]) -> Column:
    """``label: value`` lines of the fields that have a value."""
    return F.concat_ws("\n", *[F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{n}: "), c)) for n, c in fields])


def sections(rows: DataFrame, by: list[str], order: str, size: str, budget: int) -> DataFrame:
    """(by, shown ARRAY): the sections of a page, in order, that fit the budget; one too long is left out whole."""
    from tarnstone.operators.folds import fitting

    page = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("s"))
    keep = fitting(F.transform("s", lambda x: x[size]), budget)
    both = F.arrays_zip(F.transform("s", lambda x: x[order]).alias("o"), keep.alias("k"))
    return page.select(*by, F.transform(F.filter(both, lambda z: z["k"]), lambda z: z["o"]).alias("shown"))
