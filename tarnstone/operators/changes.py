"""State transitions of records: each takes tables and gives the tables after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.operators.ordering import first_per, numbered


def new_ids(rows: DataFrame, last: int, order: list[str], id_col: str = "id") -> DataFrame:
    """Ids after ``last`` for a batch of new rows, in the given order."""
    return numbered(rows, *order, name=id_col).withColumn(id_col, F.col(id_col) + F.lit(last))


def upsert(active: DataFrame, given: DataFrame, key: str, as_of: str) -> DataFrame:
    """Rows by key with ``given`` (key, value, source) applied: unknown keys are added, changed values replaced.

    A row of hand-written source keeps it; a new value clears the vector; equal values change nothing. The batch must
    have each key once (see ``last_given``).
    """
    g = given.select(F.col(key), F.col("value").alias("_value"), F.col("source").alias("_source"))
    j = active.join(g, key, "full")
    changed = F.col("_value").isNotNull() & ~F.col("value").eqNullSafe(F.col("_value"))
    return j.select(
        key,
        F.coalesce("_value", "value").alias("value"),
        F.when(F.col("source") == "manual", F.col("source")).otherwise(F.coalesce("_source", "source")).alias("source"),
        F.when(changed, F.lit(as_of)).otherwise(F.col("updated")).alias("updated"),
        F.when(changed, F.lit(False)).otherwise(F.coalesce("has_vector", F.lit(False))).alias("has_vector"),
    )


def last_given(given: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key of a batch."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return given.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def snapshots(active: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The old versions to keep: rows whose value changed, as superseded."""
    b = after.select(F.col(key), F.col("value").alias("_after"))
    return active.join(b, key).where(~F.col("value").eqNullSafe(F.col("_after"))).drop("_after").withColumn("status", F.lit("superseded"))


def supersede(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Marks the active rows of old keys as superseded by the active row of the new key, if that exists and differs."""
    active = rows.where("status = 'active'").groupBy("key").agg(F.max("id").alias("heir"))
    to = pairs.where("old_key <> new_key").join(active.withColumnRenamed("key", "new_key"), "new_key").groupBy("old_key").agg(F.min("heir").alias("heir"))
    j = rows.join(to.withColumnRenamed("old_key", "key"), "key", "left")
    hit = (F.col("status") == "active") & F.col("heir").isNotNull()
    return j.withColumn("superseded_by", F.when(hit, F.col("heir")).otherwise(F.col("superseded_by"))).withColumn("status", F.when(hit, F.lit("superseded")).otherwise(F.col("status"))).drop("heir")


def active_rows(rows: DataFrame) -> DataFrame:
    """The active row of each key (the latest, should there be several)."""
    return first_per(rows.where("status = 'active'"), ["key"], F.col("id").desc())


def supersede_into(active: DataFrame, given: DataFrame) -> DataFrame:
    """(change, key, value): what superseding (old_key, new_key, new_value) does to active rows (id, key, value, source).

    ``retired`` rows of old keys, the row of each new key ``added`` or ``updated``, and a ``snapshot`` of an updated one.
    All of a pair happens or nothing: the old key must be active, the keys must differ, a hand-written row stays. Of
    several pairs with one new key the one with the largest old id gives the value; an equal value changes no row.
    """
    old = active.select(F.col("key").alias("old_key"), F.col("id").alias("old_id"), F.col("value").alias("old_value"))
    new = active.select(F.col("key").alias("new_key"), F.col("id").alias("new_id"), F.col("value").alias("before"), F.col("source").alias("_source"))
    ok = given.where("old_key <> new_key").join(old, "old_key").join(new, "new_key", "left").where("coalesce(_source, '') <> 'manual'")
    last = ok.groupBy("new_key").agg(F.max_by(F.struct("new_value", "before"), "old_id").alias("w"), F.max("new_id").alias("new_id")).select("new_key", "w.*", "new_id")
    moved = last.where(F.col("new_id").isNull() | ~F.col("before").eqNullSafe(F.col("new_value")))
    retired = ok.select(F.lit("retired").alias("change"), F.col("old_key").alias("key"), F.col("old_value").alias("value"))
    put = moved.select(F.when(F.col("new_id").isNull(), "added").otherwise("updated").alias("change"), F.col("new_key").alias("key"), F.col("new_value").alias("value"))
    kept = moved.where("new_id IS NOT NULL").select(F.lit("snapshot").alias("change"), F.col("new_key").alias("key"), F.col("before").alias("value"))
    return retired.unionByName(put).unionByName(kept)


def transitions(rows: DataFrame, status: str, verb: str, allowed: dict[tuple[str, str], str]) -> DataFrame:
    """Rows after their verb, with ``moved``; a verb that the state doesn't allow changes nothing."""
    table = F.create_map(*[F.lit(x) for (a, v), b in allowed.items() for x in (f"{a} {v}", b)])
    to = F.try_element_at(table, F.concat_ws(" ", status, verb))
    return rows.withColumns({"moved": to.isNotNull(), status: F.coalesce(to, status)})


def files_after(known: DataFrame, walk: DataFrame, key: list[str], digest: str, kept: list[str]) -> DataFrame:
    """The files of a walk; what was known of a file (``kept``) stays only while its digest is the same."""
    old = known.select(*key, F.col(digest).alias("_old"), *kept)
    j = walk.join(old, key, "left")
    same = F.col(digest).eqNullSafe(F.col("_old"))
    return j.select(*key, digest, *[F.when(same, F.col(c)).alias(c) for c in kept])


def taken_over(mail: DataFrame, agents: DataFrame) -> DataFrame:
    """Mail (agent, ..) with ``mailbox``: the agent (agent, name, seen) that holds its agent's name, the last one seen."""
    holder = agents.groupBy("name").agg(F.max_by("agent", F.struct("seen", "agent")).alias("mailbox"))
    return mail.join(agents.select("agent", "name"), "agent").join(holder, "name")


def identifiers(given: DataFrame, known: list[str], owner: str) -> DataFrame:
    """Given identifiers (owner, type, value) with ``state``: ok, of an unknown type, or taken by an earlier owner."""
    first = given.groupBy("type", "value").agg(F.min(owner).alias("_first"))
    j = given.join(first, ["type", "value"])
    state = F.when(~F.col("type").isin(*known), "unknown type").when(F.col(owner) > F.col("_first"), "taken").otherwise("ok")
    return j.withColumn("state", state).drop("_first").select(owner, "type", "value", "state")


def mark_stale(rows: DataFrame, chosen: Column, reason: str) -> DataFrame:
    """Active rows that are chosen become stale; the reason goes below their value."""
    hit = (F.col("status") == "active") & chosen
    return rows.withColumn("value", F.when(hit, F.concat(F.col("value"), F.lit(f"\n[stale: {reason}]"))).otherwise(F.col("value"))).withColumn("status", F.when(hit, F.lit("stale")).otherwise(F.col("status")))


def pairs_add(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """Symmetric pairs with new ones added; a pair known already (in either direction) keeps its first row."""
    key = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    old = pairs.select(*key, "score", F.lit(0).alias("age"))
    every = old.unionByName(new.select(*key, "score", F.lit(1).alias("age"))).where("lo <> hi")
    return every.groupBy("lo", "hi").agg(F.min_by("score", F.struct("age", "score")).alias("score"))


def open_conflicts(conflicts: DataFrame, memory: DataFrame, distinct: DataFrame, floor: float) -> DataFrame:
    """(id, lo, hi, score): conflicts between active rows that nobody marked as distinct, scored ``floor`` or unscored."""
    c = conflicts.select("id", F.least("memory_id", "matched_id").alias("lo"), F.greatest("memory_id", "matched_id").alias("hi"), "score").where("lo <> hi")
    live = memory.where("status = 'active'").select("id")
    c = c.join(live.withColumnRenamed("id", "lo"), "lo", "left_semi").join(live.withColumnRenamed("id", "hi"), "hi", "left_semi")
    c = c.join(distinct.select("lo", "hi"), ["lo", "hi"], "left_anti")
    return c.where(F.col("score").isNull() | (F.col("score") >= floor)).select("id", "lo", "hi", "score")


def finish(rows: DataFrame, chosen: Column, done: str, resolution: str, as_of: str) -> DataFrame:
    """Closes the chosen rows that are still open; closing twice changes nothing."""
    hit = chosen & (F.col("status") != done)
    notes = F.concat(F.coalesce("notes", F.lit("")), F.lit(f"\nResolved: {resolution}"))
    return rows.withColumn("notes", F.when(hit, notes).otherwise(F.col("notes"))).withColumn("closed", F.when(hit, F.lit(as_of)).otherwise(F.col("closed"))).withColumn("status", F.when(hit, F.lit(done)).otherwise(F.col("status")))


def patched(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the non-null fields of a patch (one row a key) in place of their own."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    j = rows.join(p, key, "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def replaced_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children with all those of the keys in ``new`` replaced."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def linked(links: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Links with new ones added once."""
    return links.unionByName(new.join(links.select(keys), keys, "left_anti").dropDuplicates(keys))


def unlinked(links: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return links.join(gone.select(keys), keys, "left_anti")


def addressed(mail: DataFrame, agents: DataFrame, to: str) -> DataFrame:
    """Messages with ``recipient`` and ``state``: sent to an agent (agent, left) that is there and hasn't left, or refused."""
    there = agents.where("NOT left").select(F.col("agent").alias(to), F.col("agent").alias("recipient"))
    return mail.join(there, to, "left").withColumn("state", F.when(F.col("recipient").isNull(), "refused").otherwise("sent"))


def peeked(agents: DataFrame, unread: DataFrame, key: str, seen: str, before: str) -> DataFrame:
    """Agents with ``unread`` (is there any) and ``seen_stale`` (last seen before a moment); nothing is changed."""
    has = unread.select(key).distinct().withColumn("_has", F.lit(True))
    return agents.join(has, key, "left").withColumns({"unread": F.coalesce("_has", F.lit(False)), "seen_stale": F.col(seen) < F.lit(before).cast("timestamp_ntz")}).drop("_has")


def decision(declared: Column, candidates: Column, best: Column, manual: Column, threshold: float | None, reused: Column) -> Column:
    """What to do with a new fact: supersede what it names, insert, absorb into a near duplicate, supersede it, or flag."""
    merge = F.lit(False) if threshold is None else F.coalesce((best >= threshold) & ~manual, F.lit(False))
    return (
        F.when(declared, "supersede").when(candidates == 0, "insert").when(merge & reused, "supersede match").when(merge, "absorb").otherwise("flag")
    )


def handed_out(messages: DataFrame, mailbox: str, budget: int) -> DataFrame:
    """Messages with the unread ones that fit the budget of their mailbox marked as read."""
    from tarnstone.operators.ordering import unread_budget

    take = unread_budget(messages.where("read_at IS NULL"), mailbox, budget).select("id", F.lit(True).alias("_taken"))
    return messages.join(take, "id", "left").withColumn("taken", F.col("_taken").isNotNull()).drop("_taken")


def resolved_address(agents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, agent): an address is a name, else a session, else the only session that starts with it (four or more letters)."""
    by_name = wanted.join(agents.select(F.col("name").alias("q"), F.col("id").alias("n")), "q", "left")
    by_session = by_name.join(agents.select(F.col("session").alias("q"), F.col("id").alias("x")), "q", "left")
    pre = wanted.where(F.length("q") >= 4).join(agents.select(F.substring("session", 1, 4).alias("p"), "session", F.col("id").alias("y")), F.substring("q", 1, 4) == F.col("p")).where(F.startswith("session", F.col("q")))
    one = pre.groupBy("q").agg(F.min("y").alias("y"), F.count("*").alias("k")).where("k = 1").select("q", "y")
    return by_session.join(one, "q", "left").groupBy("q").agg(F.coalesce(F.min("n"), F.min("x"), F.min("y")).alias("agent"))
