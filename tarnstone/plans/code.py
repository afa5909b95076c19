"""Code search: match classes, line search, call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.storage import cut


def match_class(name: Column, wanted: str) -> Column:
    """0 the name itself, 1 in another case, 2 its start, 3 within it, 4 only elsewhere."""
    low, w = F.lower(name), wanted.lower()
    return F.when(name == wanted, 0).when(low == w, 1).when(F.startswith(low, F.lit(w)), 2).when(F.contains(low, F.lit(w)), 3).otherwise(4)


def lines(files: DataFrame, key: list[str], body: str) -> DataFrame:
    """(key, line_no, line): the lines of every file, without a trailing empty one; carriage returns removed."""
    text = F.regexp_replace(F.regexp_replace(F.col(body), r"\r(\n|\z)", "$1"), r"\n\z", "")
    return files.select(*key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(*key, (F.col("at") + 1).alias("line_no"), "line")


def line_search(files: DataFrame, key: list[str], body: str, query: str, per_file: int = 3) -> DataFrame:
    """(key, line_no, phrase, place): lines that have every term, those with the whole query first, a few per file.

    Files are filtered by the longer terms before they are split into lines.
    """
    terms = [t.lower() for t in query.split()]
    keep = F.lit(True)
    for t in terms:
        if len(t) >= 3:
            keep = keep & F.contains(F.lower(F.col(body)), F.lit(t))
    hit = lines(files.where(keep), key, body).withColumn("low", F.lower("line"))
    for t in terms:
        hit = hit.where(F.contains("low", F.lit(t)))
    hit = hit.withColumn("phrase", F.contains("low", F.lit(" ".join(terms))))
    w = Window.partitionBy(*key).orderBy(F.col("phrase").desc(), "line_no")
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_file).select(*key, "line_no", "phrase", "place")


def any_term_lines(files: DataFrame, key: list[str], body: str, terms: list[str]) -> DataFrame:
    """(key, line_no, terms): lines with at least one of the terms, and how many they have."""
    any_ = F.lit(False)
    n = F.lit(0)
    for t in terms:
        any_ = any_ | F.contains(F.lower(F.col(body)), F.lit(t))
        n = n + F.contains(F.lower("line"), F.lit(t)).cast("int")
    return lines(files.where(any_), key, body).withColumn("terms", n).where("terms > 0").select(*key, "line_no", "terms")


def call_graph(edges: DataFrame, seed: int, max_depth: int) -> DataFrame:
    """(node, depth): breadth-first over (a, b) from a seed; one frontier join a level, visited nodes left out."""
    spark = edges.sparkSession
    e = cut(edges.select("a", "b").distinct(), "graph")
    seen = spark.createDataFrame([(seed, 0)], "node long, depth int").join(e.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    seen = cut(seen, "seen")
    for depth in range(1, max_depth + 1):
        front = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("a"))
        new = e.join(front, "a").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)), "seen")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def supersession(rows: DataFrame, key: str, heir: str) -> DataFrame:
    """(start, node): every row that is reached from another one by following its pointer, itself included.

    Pointers are doubled each round, so a chain of n links takes log n joins; a ring or a dangling pointer ends by itself.
    """
    links = rows.where(F.col(heir).isNotNull() & (F.col(heir) != F.col(key))).select(F.col(key).alias("start"), F.col(heir).alias("node"))
    ids = rows.select(F.col(key).alias("node")).distinct()
    reach = cut(links.join(ids, "node", "left_semi").select("start", "node").distinct(), "reach")
    n = reach.count()
    while n:
        longer = reach.alias("x").join(reach.alias("y"), F.col("x.node") == F.col("y.start")).select(F.col("x.start").alias("start"), F.col("y.node").alias("node"))
        new = cut(reach.unionByName(longer).distinct(), "reach")
        m = new.count()
        reach, n, grown = new, m, m > n
        if not grown:
            break
    return reach.unionByName(rows.select(F.col(key).alias("start"), F.col(key).alias("node"))).distinct()
