"""Scores, budgets and random numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_M64 = (1 << 64) - 1


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null for other widths, a zero or a not finite norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (norm > 0) & (norm < F.lit(float("inf")))
    return F.when(ok, dot(a, b) / norm)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 4)


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def percent(c: Column) -> Column:
    return F.format_number(F.round(c * 100), 0)


def rrf(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def split_mix_first(seeds: np.ndarray) -> np.ndarray:
    """The first number of each seed's sequence."""
    with np.errstate(over="ignore"):
        z = seeds.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def split_mix(seed: int, count: int) -> list[int]:
    """The first numbers of SplitMix64 (public algorithm)."""
    out = []
    for _ in range(count):
        seed = (seed + 0x9E3779B97F4A7C15) & _M64
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        out.append(z ^ (z >> 31))
    return out
