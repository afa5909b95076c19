"""Ranks, budgets, best rows and unions of tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.storage import cut


#: Rows that one task may put in order.
ONE_TASK = 100_000


def first_per(df: DataFrame, by: list[str], *order: Column, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``rank`` keeps the place as a column."""
    name = rank or "_place"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def numbered(df: DataFrame, *order: Column | str, by: str | None = None, name: str = "place", rows: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Adds the place of each row in one order over all rows, or over those of the same ``by``, counted from 1.

    The rows are sorted in ranges and written once; a row's place is its place in its range and the sizes of the ranges
    before. No task sees more than its range; only one number a range comes to the driver. Up to ``one_task`` rows
    (``rows`` is their number or a bound of it, else they are counted), one task does the same without writing.
    """
    if (df.limit(one_task + 1).count() if rows is None else rows) <= one_task:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(by or F.lit(0)).orderBy(*order)).cast("long"))
    at = cut(df.orderBy(*([by] if by else []), *order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sizes = sorted((r.p, r.n) for r in at.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts += [F.lit(part), F.lit(before)]
        before += n
    start = F.element_at(F.create_map(*starts), F.shiftright("_at", 33)) if starts else F.lit(0)
    out = at.withColumn(name, (start + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_at")
    if by:
        first = out.groupBy(by).agg((F.min(name) - 1).alias("_first"))
        out = out.join(first, by).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
    return out


def within_budget(df: DataFrame, by: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest head of each group whose sizes fit the budget; the first row always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({"place": F.row_number().over(w), "used": run}).where((F.col("place") == 1) | (F.col("used") <= budget))


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next ``size`` rows in order of a unique key, after the last one seen (None: from the start)."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def tiers(frames: list[DataFrame], key: str | list[str]) -> DataFrame:
    """Union of ranked hit lists (key, place ..): a key stays in the first list that has it."""
    every = None
    for no, f in enumerate(frames):
        part = f.withColumn("tier", F.lit(no))
        every = part if every is None else every.unionByName(part)
    return first_per(every, [key] if isinstance(key, str) else key, F.col("tier"), F.col("place"))


def reciprocal_ranks(df: DataFrame, key: list[str], lists: list[str], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the rank columns; a null rank adds nothing."""
    total = F.lit(0.0)
    for r in lists:
        total = total + F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return df.withColumn("rrf", total)


def unread_budget(messages: DataFrame, by: str, budget: int) -> DataFrame:
    """Unread messages of each mailbox in order of id whose bodies fit the budget, at least one."""
    return within_budget(messages, [by], [F.col("id")], F.char_length("body"), budget)
