"""Vectors from a callable: the model is a parameter, its texts come one by one, its failures stop the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Embedder:
    """``fn`` gives the vector of one text; passages and queries may have prefixes of their own."""

    fn: Callable[[str], np.ndarray]
    passage: str = ""
    query: str = ""

    def one(self, text: str, as_query: bool = False) -> np.ndarray:
        return np.asarray(self.fn((self.query if as_query else self.passage) + text), np.float32)


def letters(text: str, alphabet: str = "abcdefgh") -> np.ndarray:
    """A vector without a model, for tests: how often some letters occur, at unit length (zero if none does)."""
    n = np.array([text.count(c) for c in alphabet], np.float64)
    return (n / (np.linalg.norm(n) or 1)).astype(np.float32)


def embedded(rows: DataFrame, key: str, text: str, model: Embedder, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(key, vec) of the rows with a text that isn't blank. ``progress`` hears, in each task, how many are done."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0
        for pdf in batches:
            vec = [model.one(t) for t in pdf["text"]]
            done += len(vec)
            if progress:
                progress(done)
            yield pd.DataFrame({key: pdf[key], "vec": vec})

    kind = rows.schema[key].dataType.simpleString()
    slim = rows.where(F.trim(F.col(text)) != "").select(key, F.col(text).cast("string").alias("text"))
    return slim.mapInPandas(run, f"{key} {kind}, vec array<float>")


def packed_floats(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, raw): vectors as little-endian 32-bit floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "raw": [np.asarray(v, "<f4").tobytes() for v in pdf["v"]]})

    return rows.where(F.col(vec).isNotNull()).select(key, F.col(vec).alias("v")).mapInPandas(run, f"{key} long, raw binary")


def unpacked_floats(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, vec) of packed floats; null if the bytes are no whole number of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "vec": [np.frombuffer(b, "<f4") if len(b) % 4 == 0 else None for b in pdf["raw"]]})

    return rows.select(key, F.col(raw).alias("raw")).where("raw IS NOT NULL").mapInPandas(run, f"{key} long, vec array<float>")
