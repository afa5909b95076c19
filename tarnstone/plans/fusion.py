"""Fusion of ranked lists, and the global search over record types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.operators.ordering import first_per, numbered, within_budget
from tarnstone.storage import cut

RRF_K = 60


def fused(hits: DataFrame, named: Column, k: int = RRF_K) -> DataFrame:
    """Adds rrf and place to hits (type, doc, tier 0 keyword or 1 semantic, tier_place, score, input_pos).

    A keyword hit counts by its place in the keyword list of its type, any scored hit by its place among all scores;
    exact names come first, then the sums, ties in input order.
    """
    hits = cut(hits, "hits")
    rows = hits.count()
    scored = numbered(hits.where("score IS NOT NULL").select("type", "doc", "score", "input_pos"), F.col("score").desc(), "input_pos", name="at", rows=rows)
    words = numbered(hits.where("tier = 0").select("type", "doc", "tier_place", "input_pos"), "tier_place", "input_pos", by="type", name="at", rows=rows)
    one = lambda name: (F.lit(1.0) / (k + F.col("at"))).alias(name)
    both = hits.join(words.select("type", "doc", one("kw")), ["type", "doc"], "left").join(scored.select("type", "doc", one("cos")), ["type", "doc"], "left")
    both = both.withColumns({"rrf": F.coalesce("kw", F.lit(0.0)) + F.coalesce("cos", F.lit(0.0)), "named": F.coalesce(named.cast("int"), F.lit(0))})
    return numbered(both.drop("kw", "cos"), F.col("named").desc(), F.col("rrf").desc(), "input_pos", rows=rows)


def ordered(hits: DataFrame, ranking: str, named: Column) -> DataFrame:
    """Hits with their place by the ranking asked for: ``fusion``, ``cosine``, or as they were given."""
    if ranking == "fusion":
        return fused(hits, named)
    if ranking == "cosine":
        return by_cosine(hits)
    if ranking == "given":
        return hits.withColumn("place", F.col("input_pos"))
    raise ValueError(f"no ranking: {ranking}")


def by_cosine(hits: DataFrame) -> DataFrame:
    """Scored hits by score, then the others in input order."""
    return numbered(hits, F.col("score").desc_nulls_last(), "input_pos")


def limited(placed: DataFrame, results: int, tokens: int, size: Column) -> DataFrame:
    """The first ``results`` hits whose sizes fit the token budget; one always stays."""
    head = placed.where(F.col("place") <= results).withColumn("g", F.lit(0)).drop("used")
    return within_budget(head.withColumnRenamed("place", "hit_place"), ["g"], [F.col("hit_place")], size, tokens).drop("g", "place").withColumnRenamed("hit_place", "place")


def semantic_only(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Semantic hits that no keyword list (of their type, where they have types) has."""
    key = [c for c in ("type", "doc") if c in semantic.columns and c in keyword.columns]
    return semantic.join(keyword.select(key), key, "left_anti")


def union_hits(lists: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """One list of hits with input positions: (type, tier, frame (doc, place, score)) in the fixed order of types."""
    out = None
    for no, (kind, tier, f) in enumerate(lists):
        part = f.select(F.lit(kind).alias("type"), F.col("doc").cast("long").alias("doc"), F.lit(tier).alias("tier"), F.col("place").cast("long").alias("tier_place"), F.col("score").cast("double").alias("score"), (F.lit(no) * F.lit(1_000_000_000_000) + F.col("place")).alias("input_pos"))
        out = part if out is None else out.unionByName(part)
    return first_per(out, ["type", "doc"], F.col("tier"), F.col("tier_place"))
