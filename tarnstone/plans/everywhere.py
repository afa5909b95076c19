"""Search over all record types: keyword tiers with stems, cosines of the hits, semantic tiers, fusion.

Each type is searched on its own statistics, all of them in one scan. Its hits then carry the cosine of their stored
vector, where they have one, and the semantic tier adds records that no keyword found. The lists are fused in the fixed
order of the types.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.operators.ordering import first_per
from tarnstone.operators.predicates import cut_off
from tarnstone.plans import fulltext as FT
from tarnstone.plans import fusion as FU
from tarnstone.plans import vectors as V
from tarnstone.storage import cut

#: Places in the input order that one list may take.
LIST = 1_000_000_000_000


@dataclass(frozen=True)
class Kind:
    """A record type: its rows, how they are searched, its name column, and which rows may be shown."""

    name: str
    rows: DataFrame
    source: FT.Source
    title: str | None = None
    keep: Column | None = None


@dataclass(frozen=True)
class Vectors:
    """Vectors (type, id, vec) of rows that may be shown, of one model, and the one row with the vector asked for."""

    rows: DataFrame
    asked: DataFrame
    floor: float
    margin: float | None = None


def hits(kinds: list[Kind], vectors: list[Vectors], extra: list[tuple[str, Callable[[], DataFrame]]], query: str, semantic_limit: int = 25) -> DataFrame:
    """(type, doc, tier, tier_place, score, input_pos, name) of all hits. ``extra`` makes lists that rank themselves
    (code), with doc, place and name."""
    with ThreadPoolExecutor(2 + len(vectors) + len(extra)) as lanes:  # jobs that don't wait for each other
        parts = [lanes.submit(lambda v=v: cut(V.similar_to(v.rows, v.asked, "vec").select("type", F.col("id").cast("long").alias("doc"), "score"), "scores")) for v in vectors]
        made = [lanes.submit(lambda make=make: cut(make().select("doc", "place", "name"), "list")) for _, make in extra]
        words = lanes.submit(FT.search_all, [(k.name, k.rows, k.source, k.keep) for k in kinds], query).result()
        extra = [(kind, m.result()) for (kind, _), m in zip(extra, made, strict=True)]
        parts = [x.result() for x in parts]
    words = words.select("type", "doc", (F.col("tier") * 1_000_000_000 + F.col("place")).alias("place"))
    scored = near = None
    for v, part in zip(vectors, parts, strict=True):
        best = cut_off(part, ["type"], v.floor, v.margin)
        scored, near = (part, best) if scored is None else (scored.unionByName(part), near.unionByName(best))
    column = lambda f, tier: f.select("type", "doc", F.lit(tier).alias("tier"), F.col("place").cast("long").alias("tier_place"), "score")
    if scored is None:
        found = column(words.withColumn("score", F.lit(None).cast("double")), 0)
    else:
        near = first_per(FU.semantic_only(near, words), ["type"], F.col("score").desc(), F.col("doc"), n=semantic_limit, rank="place")
        found = column(words.join(scored, ["type", "doc"], "left"), 0).unionByName(column(near, 1))
    order = [k.name for k in kinds] + [name for name, _ in extra]
    names = None
    for kind, rows in extra:
        found = found.unionByName(column(rows.select(F.lit(kind).alias("type"), F.col("doc").cast("long").alias("doc"), "place", F.lit(None).cast("double").alias("score")), 0))
    for kind, rows, key, title in [(k.name, k.rows, k.source.key, k.title) for k in kinds if k.title] + [(n, r, "doc", "name") for n, r in extra]:
        part = rows.select(F.lit(kind).alias("type"), F.col(key).cast("long").alias("doc"), F.col(title).cast("string").alias("name"))
        names = part if names is None else names.unionByName(part)
    place = F.lit(0)
    for no, name in enumerate(order):
        place = F.when(F.col("type") == name, F.lit(no)).otherwise(place)
    found = found.withColumn("input_pos", (place * 2 + F.col("tier")) * F.lit(LIST) + F.col("tier_place"))
    return found.join(names, ["type", "doc"], "left") if names is not None else found.withColumn("name", F.lit(None).cast("string"))


def search(kinds: list[Kind], vectors: list[Vectors], extra: list[tuple[str, Callable[[], DataFrame]]], query: str, ranking: str = "fusion", semantic_limit: int = 25) -> DataFrame:
    """The hits with rrf (by fusion) and place, by the ranking asked for; a hit whose name is the query comes first."""
    return FU.ordered(hits(kinds, vectors, extra, query, semantic_limit), ranking, F.lower(F.trim("name")) == query.strip().lower())
