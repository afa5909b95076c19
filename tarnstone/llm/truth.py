"""Best representative of each duplicate group (problem 2): iterative truth discovery.

Every record of a group claims a value for each of its fields. Two estimates feed each other until they settle:

* the support of a value is the summed weight of the sources that claim it, a source's weight being
  ``-ln(1 - reliability)``;
* the reliability of a source is the mean share that its claims hold of all the support in their (group, field).

The value with the highest support wins. Where the user states an order of trust (``precedence``), a better claim
outweighs any number of worse ones: support is compared as the pair (best precedence among the claimants, learned
support), which is the limit of weights that grow by an unbounded factor from rank to rank.

Claims are first summed to one row per (group, field, value) with a count per source; there are at most ``len(sources)``
counts, so a key of any length of history is combined on the map side. Only the reliabilities, one number for each of
a fixed list of sources, ever reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.storage import cut

STATUSES = ("active", "stale", "superseded", "other")
SOURCES = ("manual", "imported", "distilled", "session", "claude-auto", "other")
FIELDS = ("value", "tags", "reviewed_at")
_OUTER = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$"


def clean(c: Column | str) -> Column:
    """Lower case without outer white space of any script."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), _OUTER, "")


def instant(c: str) -> Column:
    """Microseconds of a typed or imported stamp, null if it can't be read.

    Digits only are epoch seconds; a stamp without offset is UTC; the time may lack its seconds or be missing.
    """
    s = F.trim(F.col(c))
    shape = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,9})?)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"
    part = lambda k: F.regexp_extract(s, shape, k)
    or_ = lambda k, other: F.when(part(k) == "", F.lit(other)).otherwise(part(k))
    zone = F.regexp_replace(F.upper(or_(4, "Z")), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    stamp = F.concat(part(1), F.lit("T"), or_(2, "00:00"), or_(3, ":00"), zone)
    return (
        F.when(s.rlike(r"^\d{1,12}$"), s.try_cast("bigint") * 1_000_000)
        .when(s.rlike(shape), F.unix_micros(stamp.try_cast("timestamp")))
        .otherwise(F.lit(None).cast("bigint"))
    )


def _rank(c: Column, names: tuple[str, ...]) -> Column:
    """Position of a cleaned word in ``names``; the last name stands for anything else and for null."""
    out = F.lit(len(names) - 1)
    for k in reversed(range(len(names) - 1)):
        out = F.when(c == names[k], F.lit(k)).otherwise(out)
    return out


def memory_claims(memory: DataFrame) -> DataFrame:
    """(grp, row, source, precedence, record, value, tags, reviewed_at): memory rows in groups of two or more.

    The field columns hold a fingerprint of the content, or null where the field isn't filled. Rows without a key are
    in no group.
    """
    rows = memory.select(
        F.col("id").cast("long").alias("row"),
        clean("key").alias("grp"),
        F.col("superseded_by").cast("long").alias("heir"),
        _rank(clean("status"), STATUSES).alias("s"),
        _rank(clean("source"), SOURCES).alias("o"),
        instant("updated_at").alias("at"),
        F.when(F.regexp_replace("value", _OUTER, "") != "", F.xxhash64("value")).alias("value"),
        F.when((F.json_array_length("tags") > 0) & F.rtrim("tags").endswith("]"), F.xxhash64("tags")).alias("tags"),
        F.when(F.col("reviewed_at").isNotNull(), F.xxhash64("reviewed_at")).alias("reviewed_at"),
    ).where("grp IS NOT NULL AND row IS NOT NULL")
    many = rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    rows = rows.join(many, "grp", "left_semi")
    heirs = rows.select("grp", F.col("row").alias("heir"), F.lit(1).alias("gone")).distinct()
    joined = rows.join(heirs, ["grp", "heir"], "left")
    return joined.select(
        "grp",
        "row",
        (F.col("s") * len(SOURCES) + F.col("o")).alias("source"),
        F.struct(
            F.when(F.col("gone").isNotNull() & (F.col("heir") != F.col("row")), 0).otherwise(1).alias("alive"),
            (-F.col("s")).alias("s"),
            (-F.col("o")).alias("o"),
            F.col("at").isNotNull().alias("dated"),
            F.coalesce("at", F.lit(0)).alias("at"),
            F.col("row").alias("id"),
        ).alias("precedence"),
        F.col("row").alias("record"),
        *FIELDS,
    )


def discover_truth(
    claims: DataFrame,
    fields: list[str],
    n_sources: int,
    *,
    precedence: bool,
    rounds: int = 8,
    tolerance: float = 0.005,
    start: float = 0.7,
) -> DataFrame:
    """(grp, field, value BIGINT, row BIGINT, support DOUBLE): the winning value of each field of each group.

    ``claims`` has grp, row, source (0 .. n_sources-1), a comparable ``precedence`` struct and one nullable BIGINT
    column per field. ``row`` is the claimant of the winning value that comes first by precedence. A field claimed by
    nobody gives no row; equal support goes to the better precedence; empty input gives an empty result.
    """
    long = claims.select(
        "grp", "row", "source", "precedence",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("value")) for f in fields])).alias("c"),
    ).select("grp", "row", "source", "precedence", "c.field", "c.value").where("value IS NOT NULL")
    counted = [F.count_if(F.col("source") == k).alias(f"n{k}") for k in range(n_sources)]
    votes = cut(
        long.groupBy("grp", "field", "value").agg(
            F.max(F.struct("precedence", "row")).alias("best"), *counted
        ).select("grp", "field", "value", "best", F.array(*[F.col(f"n{k}").cast("int") for k in range(n_sources)]).alias("n")),
        "votes",
    )
    trust = [start] * n_sources
    for _ in range(rounds):
        scored = votes.withColumn("support", _support(trust))
        total = scored.groupBy("grp", "field").agg(F.sum("support").alias("total"))
        share = scored.join(total, ["grp", "field"]).select("n", (F.col("support") / F.col("total")).alias("share"))
        got = share.agg(
            *[F.sum(F.col("n")[k] * F.col("share")).alias(f"s{k}") for k in range(n_sources)],
            *[F.sum(F.col("n")[k]).alias(f"c{k}") for k in range(n_sources)],
        ).first()
        # a prior of two claims keeps a source with few claims near the start
        new = [((got[f"s{k}"] or 0.0) + 2 * start) / ((got[f"c{k}"] or 0) + 2) for k in range(n_sources)]
        moved = max(abs(a - b) for a, b in zip(new, trust, strict=True))
        trust = new
        if moved < tolerance:
            break
    scored = votes.withColumn("support", _support(trust))
    order = F.struct("best", "support") if precedence else F.struct("support", "best")
    return scored.groupBy("grp", "field").agg(F.max_by(F.struct("value", "best", "support"), order).alias("w")).select(
        "grp", "field", F.col("w.value").alias("value"), F.col("w.best.row").alias("row"), F.col("w.support").alias("support")
    )


def _support(trust: list[float]) -> Column:
    weight = [-math.log(1 - min(0.99, max(0.01, t))) for t in trust]
    out = F.lit(0.0)
    for k, w in enumerate(weight):
        out = out + F.col("n")[k] * F.lit(w)
    return out


def survivors(memory: DataFrame) -> DataFrame:
    """(memory_key, field, from_id) by the stated order of trust: see ``discover_truth`` with precedence."""
    found = discover_truth(memory_claims(memory), ["record", *FIELDS], len(STATUSES) * len(SOURCES), precedence=True)
    return found.select(F.col("grp").alias("memory_key"), "field", F.col("row").alias("from_id"))


def supported_values(memory: DataFrame) -> DataFrame:
    """(memory_key, field, from_id, support): the same groups where only the learned reliability decides."""
    found = discover_truth(memory_claims(memory), list(FIELDS), len(STATUSES) * len(SOURCES), precedence=False)
    return found.select(
        F.col("grp").alias("memory_key"), "field", F.col("row").alias("from_id"), F.round("support", 6).alias("support")
    )
