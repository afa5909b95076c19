"""What a session is shown at its start: the memories that matter to a repository, and a page of sections in a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.operators.folds import fitting
from tarnstone.operators.ordering import first_per, numbered


def relevant_memories(memory: DataFrame, repos: DataFrame, limit: int, reserved: int) -> DataFrame:
    """(repo, id, place): for each repository (repo, name) up to ``limit`` active memories (id, key, value, memory_type, at).

    First ``reserved`` corrections (type feedback), then the memories whose key names the repository, then those of type
    feedback or project whose value does (corrections first in both), then the latest corrections, then the latest
    project memories. A key is shown once. Names meet texts by their words, in a join; only the latest few of two types
    go to every repository.
    """
    m = memory.withColumn("fb", (F.col("memory_type") == "feedback").cast("int"))
    words = lambda c: F.array_distinct(F.split(F.lower(c), "[^a-z0-9-]+"))
    name = repos.select("repo", F.lower("name").alias("word"))
    in_key = m.where("memory_type <> 'session'").select("id", F.explode(words("key")).alias("word")).join(name, "word").select("repo", "id", F.lit(0).alias("tier"))
    in_value = m.where("memory_type IN ('feedback', 'project')").select("id", F.explode(words("value")).alias("word")).join(name, "word").select("repo", "id", F.lit(1).alias("tier"))
    latest = [m.where(F.col("memory_type") == t).orderBy(F.col("at").desc(), "id").limit(limit).select("id", F.lit(k).alias("tier")) for k, t in ((2, "feedback"), (3, "project"))]
    few = latest[0].unionByName(latest[1])  # at most twice the limit
    found = in_key.unionByName(in_value).unionByName(repos.select("repo").crossJoin(F.broadcast(few)))
    found = found.groupBy("repo", "id").agg(F.min("tier").alias("tier")).join(m.select("id", "key", "fb", "at"), "id")
    order = [F.col("tier"), F.col("fb").desc(), F.col("at").desc(), F.col("id")]
    found = first_per(found, ["repo", "key"], *order)
    first = first_per(found.where("fb = 1 AND tier < 3"), ["repo"], *order, n=reserved, rank="slot").select("repo", "id", "slot")
    found = found.join(first, ["repo", "id"], "left")
    return first_per(found, ["repo"], F.col("slot").isNull(), F.col("slot"), *order, n=limit, rank="place").select("repo", "id", F.col("place").cast("long").alias("place"))


def section(title: str, count: Column, lines: Column) -> Column:
    """A heading with a count and its lines; null without a line."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"### {title} ("), count.cast("string"), F.lit(")\n"), F.array_join(lines, "\n"), F.lit("\n\n")))


def top_lines(rows: DataFrame, order: list[Column], line: Column, title: str, shown: int) -> DataFrame:
    """One row (text): the section of the first few rows of a whole table, with the number of all."""
    few = numbered(rows.orderBy(*order).limit(shown).withColumn("line", line), *order, rows=shown)
    lines = few.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    return rows.agg(F.count("*").alias("n")).crossJoin(lines).select(section(title, F.col("n"), F.col("lines")).alias("text"))  # one row each


def page(sections: list[Column], budget: int) -> tuple[Column, Column]:
    """(shown, text): the numbers of the sections that fit, in order, and the page. A section that doesn't fit what is left
    of the budget (bytes / 4, rounded up) is left out whole; later ones may still fit."""
    texts = F.array(*[F.coalesce(t, F.lit("")) for t in sections])
    keep = fitting(F.transform(texts, lambda t: F.ceil(F.octet_length(t) / 4).cast("bigint")), budget)
    both = F.filter(F.zip_with(texts, keep, lambda t, k: F.struct(t.alias("t"), (k & (t != "")).alias("k"))), lambda x: x["k"])
    shown = F.filter(F.transform(F.zip_with(texts, keep, lambda t, k: k & (t != "")), lambda k, i: F.when(k, i + 1)), lambda i: i.isNotNull())
    return F.array_join(shown.cast("array<string>"), ","), F.array_join(F.transform(both, lambda x: x["t"]), "")
