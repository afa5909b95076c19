"""Exact vector search: cosine scores, best chunk per record, overlap suppression."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnstone.storage import cut


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with the rows of b; NaN where a norm is zero or not finite."""
    with np.errstate(all="ignore"):
        na, nb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
        return (a @ b.T) / (na * nb.T)


def similar_to(rows: DataFrame, query: DataFrame, vec: str) -> DataFrame:
    """``rows`` without the vector, with ``score``: the cosine with the one vector of ``query``.

    Vectors of another width, not finite or of zero length have no score and are left out. The query is one vector and
    travels with the code; the rows are only scanned.
    """
    one = query.select(vec).limit(1).collect()
    keep = [f for f in rows.schema.fields if f.name != vec]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])
    if not one or one[0][0] is None:
        return rows.sparkSession.createDataFrame([], schema)
    q = np.asarray(one[0][0], np.float64)[None]
    names, width = [f.name for f in keep], q.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            out = pdf[names].copy()
            out["score"] = cosine(np.stack(pdf[vec].to_numpy()).astype(np.float64), q)[:, 0]
            yield out[np.isfinite(out["score"])]

    return rows.where(F.size(vec) == width).select(*names, vec).mapInPandas(run, schema)


def top_k(scored: DataFrame, k: int, tie: str) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), tie).limit(k)


def best_per_record(scored: DataFrame, record: str, tie: str, k: int) -> DataFrame:
    """The best chunk of each record, then the ``k`` best records: filters and collapse come before the limit."""
    w = Window.partitionBy(record).orderBy(F.col("score").desc(), tie)
    best = scored.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")
    return top_k(best, k, tie)


def without_overlaps(scored: DataFrame, by: list[str], first: str, last: str, tie: str) -> DataFrame:
    """Greedily, best first: a chunk stays unless it overlaps one kept before in the same file. Ends given the wrong way
    round are taken in order.

    Kept chunks don't overlap one another, so a sorted list of their ends tells in logarithmic time whether a new one fits.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", tie], ascending=[False, True], ignore_index=True)
        starts, ends, kept = [], [], []
        for at, (a, b) in enumerate(zip(pdf[[first, last]].min(axis=1).tolist(), pdf[[first, last]].max(axis=1).tolist(), strict=True)):
            k = bisect.bisect_left(ends, a)  # the first kept chunk that doesn't end before this one begins
            if k == len(ends) or starts[k] > b:
                starts.insert(k, a)
                ends.insert(k, b)
                kept.append(at)
        return pdf.iloc[kept]

    return scored.groupBy(*by).applyInPandas(run, scored.schema)


def best_keys(rows: DataFrame, probes: DataFrame, key: str, asked: str, vec: str, k: int, block: int = 4096) -> DataFrame:
    """(asked, key, score): for every ``asked`` the ``k`` keys with the best cosine to any of its probes.

    Probes are a stated set and go out in blocks by what they are for; each task keeps the best keys it has met, and only
    those meet. Vectors without a length have no score.
    """
    sent = cut(probes.select(F.col(asked).alias("a"), F.col(vec).alias("v")), "probes")
    blocks = max(1, -(-sent.count() // block))
    kind = rows.schema[key].dataType.simpleString()
    out = None
    for b in range(blocks):
        got = sent.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == b).toArrow()
        if not got.num_rows:
            continue
        names, of = np.unique(got["a"].to_numpy(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        q, starts = np.array(got["v"].to_pylist(), np.float64)[order], np.searchsorted(of[order], np.arange(len(names)))

        def run(batches: Iterator[pd.DataFrame], names=names, q=q, starts=starts) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                s = cosine(q, np.stack(pdf[vec].to_numpy()).astype(np.float64))
                best = np.maximum.reduceat(np.where(np.isfinite(s), s, -2), starts, axis=0)
                found = pd.DataFrame({asked: np.repeat(names, len(pdf)), key: np.tile(pdf[key].to_numpy(), len(names)), "score": best.ravel()})
                found = found[found["score"] > -2].groupby([asked, key], as_index=False)["score"].max()
                yield found.sort_values("score", ascending=False).groupby(asked).head(k)

        part = rows.select(key, vec).mapInPandas(run, f"{asked} long, {key} {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"{asked} long, {key} {kind}, score double")
    best = out.groupBy(asked, key).agg(F.max("score").alias("score"))
    w = Window.partitionBy(asked).orderBy(F.col("score").desc(), key)
    return best.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= k).drop("_p")


def nearest_records(rows: DataFrame, queries: DataFrame, vec: str, key: str, k: int, block: int = 4096) -> DataFrame:
    """(query_key, key, score, place): the ``k`` most similar rows of each query vector, exactly.

    Queries are a stated set. They are written in blocks of about ``block`` vectors, each block is one scan of the rows,
    each task keeps its ``k`` best per query, and only those meet in the final rank.
    """
    asked = cut(queries.select(F.col(key).cast("long").alias("q"), F.col(vec).alias("v")).where(F.col(vec).isNotNull()), "queries")
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        if got.num_rows:
            part = _nearest_of(rows, got["q"].to_numpy(), np.array(got["v"].to_pylist(), np.float64), vec, key, k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query_key long, {key} long, score double, place int")
    w = Window.partitionBy("query_key").orderBy(F.col("score").desc(), key)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _nearest_of(rows: DataFrame, keys: np.ndarray, q: np.ndarray, vec: str, key: str, k: int) -> DataFrame:
    width = q.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf[key].to_numpy()
            s = cosine(q, np.stack(pdf[vec].to_numpy()).astype(np.float64))
            s[~np.isfinite(s) | (keys[:, None] == ids[None])] = -2
            n = min(k, len(ids))
            part = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out = pd.DataFrame({"query_key": np.repeat(keys, n), key: ids[part.ravel()], "score": np.take_along_axis(s, part, 1).ravel()})
            yield out[out["score"] > -2]

    return rows.where(F.size(vec) == width).select(key, vec).mapInPandas(run, f"query_key long, {key} long, score double")
