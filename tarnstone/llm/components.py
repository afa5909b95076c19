"""Consolidating pairwise matches into groups (problem 4): connected components over a two-dimensional grid.

Vertices are hashed into ``side`` blocks; an edge (u, v) belongs to the cell (block(u), block(v)). One round:

1. every cell runs union-find over its own edges and keeps, for each of its vertices, the first vertex that the cell
   links it with (its representative);
2. a vertex meets the representatives that the cells of its row and of its column chose; the first becomes its parent,
   and each other representative becomes an edge to that parent;
3. the edges between representatives are the next round's graph.

"First" is by an order that is drawn anew each round: whatever the shape of the graph, a third of the edges or more is
expected to go in a round (in the order of the ids, a chain of ascending ids would lose hardly any). The rounds end when
no edge is left. Then the parents are resolved from the last round back to the first, each step one join over a level
that is smaller than the one before, and the groups are named by their smallest vertex. No vertex or group is ever in
one task: a vertex that holds a third of all links has them spread over the ``side`` cells of its row, and after step 1
it has at most two rows a block.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.storage import cut, drop

#: Edges that one cell should hold; the grid's side follows from it and the number of edges.
CELL_EDGES = 250_000
MIN_SIDE = 1


def priority(ids: np.ndarray, draw: int) -> np.ndarray:
    """A number for each vertex that orders them at random, the same wherever it is computed in a round."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def local_roots(u: np.ndarray, v: np.ndarray, draw: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges (u[i], v[i]) with array hooks and full path compression.

    Returns the vertices and, for each, the first vertex of its component in the order of this draw.
    """
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.argsort(priority(ids, draw), kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    at = rank[at]
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(ids))
    while True:
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            return ids[order], ids[order][parent]
        pa, pb = pa[open_], pb[open_]
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _cell(draw: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, roots = local_roots(pdf["u"].to_numpy(), pdf["v"].to_numpy(), draw)
        return pd.DataFrame({"vertex": ids, "rep": roots, "p": priority(roots, draw)})

    return run


def connected_components(
    edges: DataFrame, u: str = "u", v: str = "v", cell_edges: int = CELL_EDGES, min_side: int = MIN_SIDE
) -> DataFrame:
    """(vertex BIGINT, component BIGINT): for every vertex of an edge the smallest vertex it is linked with.

    Null ends are ignored; a loop makes its vertex a component of one unless it has other links; repeated and reversed
    edges count once; an empty input gives an empty result; other columns of ``edges`` are not looked at.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull()
    )
    levels: list[DataFrame] = []
    graph = cut(e, "edges")
    first = graph
    n = graph.count()
    while n:
        side = max(min_side, math.isqrt(max(1, n // cell_edges)) + 1)
        cells = graph.withColumns(
            {
                "row": F.pmod(F.xxhash64("u"), F.lit(side)).cast("int"),
                "col": F.pmod(F.xxhash64("v"), F.lit(side)).cast("int"),
            }
        )
        stars = cells.groupBy("row", "col").applyInPandas(_cell(len(levels)), "vertex long, rep long, p long")
        seen = stars.groupBy("vertex").agg(F.min(F.struct("p", "rep"))["rep"].alias("parent"), F.collect_set("rep").alias("reps"))
        level = cut(seen, "level")
        levels.append(level)
        nxt = cut(
            level.select("parent", F.explode("reps").alias("rep"))
            .where("rep <> parent")
            .select(F.col("rep").alias("u"), F.col("parent").alias("v"))
            .distinct(),
            "edges",
        )
        if graph is not first:
            drop(graph)
        graph, n = nxt, nxt.count()
    if not levels:
        return e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    found = levels[-1].select("vertex", F.col("parent").alias("component"))
    for level in reversed(levels[:-1]):
        upper = found.select(F.col("vertex").alias("parent"), "component")
        found = level.select("vertex", "parent").join(upper, "parent", "left").select(
            "vertex", F.coalesce("component", "parent").alias("component")
        )
    named = found.groupBy("component").agg(F.min("vertex").alias("least"))
    return found.join(named, "component").select("vertex", F.col("least").alias("component"))


def consolidate(
    memory: DataFrame, conflicts: DataFrame, floor: float = 0.7, cell_edges: int = CELL_EDGES, min_side: int = MIN_SIDE
) -> DataFrame:
    """(memory_id, group_id) of every memory with an accepted link.

    A conflict row links its two memories if both ids exist in ``memory``, differ, and its score is null or at least
    ``floor`` (NaN is above every number, as in SQL). Repeated and reversed rows are one link; late rows count like any other.
    """
    ids = memory.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    links = (
        conflicts.where("memory_id <> matched_id")
        .where(F.col("score").isNull() | (F.col("score") >= floor))
        .select(
            F.least("memory_id", "matched_id").cast("long").alias("u"),
            F.greatest("memory_id", "matched_id").cast("long").alias("v"),
        )
        .distinct()
        .join(ids.select(F.col("id").alias("u")), "u", "left_semi")
        .join(ids.select(F.col("id").alias("v")), "v", "left_semi")
    )
    return connected_components(links, "u", "v", cell_edges, min_side).select(
        F.col("vertex").alias("memory_id"), F.col("component").alias("group_id")
    )
