"""Retrieval quality: recall, reciprocal rank, nDCG, summaries, bootstrap, comparison with a baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.functions.maths import split_mix


def scores(results: DataFrame, relevant: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """(q, recall, rr, ndcg) from results (q, label, place) and relevant (q, label); a label counts once, where first."""
    first = results.groupBy("q", "label").agg(F.min("place").alias("place"))
    want = relevant.select("q", "label").distinct()
    total = want.groupBy("q").agg(F.count("*").alias("want"))
    hit = first.join(want, ["q", "label"], "left_semi")
    gain = F.when(F.col("place") <= depth, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    got = hit.groupBy("q").agg(F.count_if(F.col("place") <= k).alias("found"), F.min("place").alias("best"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("want", F.lit(depth)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return total.join(got, "q", "left").select(
        "q",
        (F.coalesce("found", F.lit(0)) / F.col("want")).alias("recall"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def rankers(named: Column) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The rankings an evaluation compares, the baseline first; each takes hits and gives them places."""
    from tarnstone.plans import fusion

    return {
        "current": lambda hits: fusion.ordered(hits, "fusion", named),
        "keyword": lambda hits: fusion.ordered(hits.where("tier = 0"), "given", named),
        "cosine": lambda hits: fusion.ordered(hits.where("score IS NOT NULL"), "cosine", named),
        "cosine-order": lambda hits: fusion.ordered(hits, "cosine", named),
    }


def ranked(hits: DataFrame, by: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The hits under every ranker: (ranker, doc, place)."""
    out = None
    for name, ranker in by.items():
        part = ranker(hits).select(F.lit(name).alias("ranker"), "doc", F.col("place").cast("int").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def summary(per_query: DataFrame, kinds: DataFrame, digits: int = 3) -> DataFrame:
    """Means by kind and over all."""
    rows = per_query.join(kinds, "q")
    return rows.groupingSets([["kind"], []], "kind").agg(*[F.round(F.avg(c), digits).alias(c) for c in ("recall", "rr", "ndcg")], F.count("*").alias("n")).select(F.coalesce("kind", F.lit("all")).alias("grp"), "recall", "rr", "ndcg", "n")


def tokens_to_first(results: DataFrame, relevant: DataFrame, size: str) -> DataFrame:
    """(q, tokens): what a reader takes in up to the first relevant result."""
    best = results.join(relevant, ["q", "label"], "left_semi").groupBy("q").agg(F.min("place").alias("best"))
    return results.join(best, "q").where("place <= best").groupBy("q").agg(F.sum(size).alias("tokens"))


def bootstrap(diffs: DataFrame, column: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(low, mean, high): 95 % interval of the mean of paired differences; the queries of an evaluation are a short list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = [v for pdf in batches for v in sorted(pdf[column].tolist())]
        if values:
            n = len(values)
            picks = split_mix(seed, n * resamples)
            means = sorted(sum(values[p % n] for p in picks[i * n : (i + 1) * n]) / n for i in range(resamples))
            at = lambda q: means[round(q * (resamples - 1))]
            yield pd.DataFrame({"low": [at(0.025)], "mean": [sum(values) / n], "high": [at(0.975)]})

    return diffs.select(column).coalesce(1).mapInPandas(run, "low double, mean double, high double")


def moved(before: DataFrame, after: DataFrame, key: str, value: str, tolerance: float = 0.05) -> DataFrame:
    """Keys on one side only, and values that moved by more than ``tolerance``."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full").where(F.col("before").isNull() | F.col("after").isNull() | (F.abs(F.col("after") - F.col("before")) > tolerance))
