"""Greedy rules whose state depends on all rows before: each group is one short ordered list (a session, a page)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(rows: DataFrame, by: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Adds ``pack``: consecutive rows go into one pack while their sizes fit; a row too large is a pack of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        packs, used, no = [], 0, 0
        for n in pdf[size]:
            if packs and used + n > limit:
                no, used = no + 1, 0
            packs.append(no)
            used += n
        return pdf.assign(pack=packs)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(*by).applyInPandas(run, f"{schema}, pack int")


def fitting(sizes: Column, budget: int) -> Column:
    """For an array of sizes in order: which ones stay if one that doesn't fit is left out and later ones still may."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("keep"))

    def step(state: Column, n: Column) -> Column:
        fits = state["used"] + n.cast("bigint") <= budget
        return F.struct((state["used"] + F.when(fits, n.cast("bigint")).otherwise(F.lit(0))).alias("used"), F.concat(state["keep"], F.array(fits)).alias("keep"))

    return F.aggregate(sizes, start, step, lambda s: s["keep"])
