"""Filters of lists and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.functions.text import contains_literal


def by_key_active_first(df: DataFrame, key: str) -> DataFrame:
    """The active row of a key, else its newest history row."""
    active = F.col("status") == "active"
    return df.where(F.col("key") == key).orderBy(active.desc(), F.col("updated_at").desc(), F.col("id").desc()).limit(1)


def listed(df: DataFrame, column: str, value: str | None, default: str | None = None) -> DataFrame:
    """Rows of a status: ``all`` is no filter, None is the default (or no filter)."""
    wanted = default if value is None else value
    return df if wanted in (None, "all") else df.where(F.col(column) == wanted)


def in_range(column: Column, low: str | None, high: str | None) -> Column:
    """Inclusive range of stamps; an open side has no bound; what isn't a stamp is out once there is one."""
    stamp = F.date_trunc("second", column.try_cast("timestamp_ntz"))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (stamp >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        ok = ok & (stamp <= F.lit(high).cast("timestamp_ntz"))
    return F.coalesce(ok, F.lit(False))


def due_within(deadline: Column, as_of: str, days: int) -> Column:
    """Deadline known and not after ``as_of`` plus ``days``: overdue rows count."""
    return deadline.isNotNull() & (deadline <= F.date_add(F.lit(as_of).cast("date"), days))


def needs_review(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Active rows never reviewed or not for ``days`` days, longest waiting first."""
    old = F.col("reviewed_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return df.where((F.col("status") == "active") & (F.col("reviewed_at").isNull() | old))


def matches_text(columns: list[str], query: str) -> Column:
    """Literal substring match in any of the columns, ASCII case folded; null columns match nothing."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(contains_literal(c, query), F.lit(False))
    return hit


def scope_matches(root: Column, remote: Column, name: Column, here: dict[str, str | None]) -> Column:
    """Same root commit, or same remote, or (neither known) the same name."""
    same = lambda c, v: F.coalesce(c == F.lit(v), F.lit(False)) if v is not None else F.lit(False)
    return same(root, here.get("root")) | same(remote, here.get("remote")) | (root.isNull() & remote.isNull() & same(name, here.get("name")))


def cut_off(scored: DataFrame, by: list[str], floor: float, margin: float | None) -> DataFrame:
    """Rows of at least ``floor`` and, with a margin, within it of the best row of their group."""
    keep = scored.where(F.col("score") >= floor)
    if margin is None:
        return keep
    best = keep.groupBy(*by).agg(F.max("score").alias("_best")) if by else keep.agg(F.max("score").alias("_best"))
    joined = keep.join(best, by) if by else keep.crossJoin(F.broadcast(best))  # one row
    return joined.where(F.col("score") >= F.col("_best") - F.lit(margin)).drop("_best")


def model_allows(recorded: Column, configured: str) -> Column:
    """Vectors of the configured model, or of a model nobody recorded."""
    return recorded.isNull() | (recorded == configured)


def unsafe_root(path: Column, home: str) -> Column:
    """Fewer than three parts, the home folder, or a folder above it."""
    clean = F.regexp_replace(path, "/+$", "")
    parts = F.size(F.filter(F.split(clean, "/"), lambda p: p != ""))
    return (parts < 3) | (clean == home) | F.lit(home).startswith(F.concat(clean, F.lit("/")))


def inside(path: Column, root: Column) -> Column:
    """The path stays below the root: no part goes up."""
    return ~F.array_contains(F.split(path, "/"), "..") & F.startswith(path, F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def repo_name_filter(name: Column, wanted: str) -> Column:
    return F.contains(F.lower(name), F.lit(wanted.lower()))


