"""Incremental and stateful operators: manifests, staged rebuilds, activity, exactly-once hand-out.

Each is a batch function; ``stream_*`` are the Structured Streaming forms, run over what is available now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnstone import storage


def changed(manifest: DataFrame, known: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key, change): rows of a manifest that are new, of another digest, or gone."""
    a, b = manifest.select(*key, F.col(digest).alias("_new")), known.select(*key, F.col(digest).alias("_old"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*key, change.alias("change"))


def reused_vectors(new: DataFrame, old: DataFrame, text: str, vector: str) -> DataFrame:
    """New chunks with the vector an old chunk of the same text had (of several the smallest id), else null.

    Texts meet by their digest: the texts themselves aren't shuffled twice.
    """
    known = old.where(F.col(vector).isNotNull()).select(F.sha2(F.col(text), 256).alias("_t"), "id", vector)
    one = known.groupBy("_t").agg(F.min_by(vector, "id").alias(vector))
    return new.withColumn("_t", F.sha2(F.col(text), 256)).join(one, "_t", "left").drop("_t")


def stale_chunks(rows: DataFrame, signature: str, column: str) -> DataFrame:
    return rows.where(~F.col(column).eqNullSafe(F.lit(signature)))


def due_sessions(turns: DataFrame, marks: DataFrame, session: str, least: int = 5, step: int = 50) -> DataFrame:
    """(session, turns, done): sessions with enough turns, and ``step`` more than at their last mark."""
    n = turns.groupBy(session).agg(F.count("*").alias("turns"))
    return n.join(marks, session, "left").withColumn("done", F.coalesce("done", F.lit(0).cast("bigint"))).where((F.col("turns") >= least) & ((F.col("done") == 0) | (F.col("turns") - F.col("done") >= step)))


def run_history(events: DataFrame, by: str, order: list[str], starts: Column, keep: int) -> DataFrame:
    """The last ``keep`` entries of each history with started and crashed: a start that a start follows had no end."""
    later = Window.partitionBy(by).orderBy(*order)
    newest = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    rows = events.withColumn("started", starts)
    rows = rows.withColumns({"crashed": F.coalesce(F.col("started") & F.lead("started").over(later), F.lit(False)), "age": F.row_number().over(newest)})
    return rows.where(F.col("age") <= keep)


def jobs_run(jobs: DataFrame, worker: str, order: list[str], ends: Column) -> DataFrame:
    """Jobs with turn, state and attempts after a run, oldest first: a failed job stops only itself, an interrupted one is
    queued again with one attempt more."""
    w = Window.partitionBy(worker).orderBy(*order)
    cut_off = ends == "interrupted"
    return jobs.withColumns({"turn": F.row_number().over(w).cast("long"), "state": F.when(cut_off, "queued").otherwise(ends), "attempts": cut_off.cast("int")})


def appended(log: DataFrame, new: DataFrame, at: str, days: int, now: DataFrame) -> DataFrame:
    """The log with new rows, without those older than ``days`` before ``now`` (one row)."""
    rows = log.unionByName(new).crossJoin(F.broadcast(now))
    return rows.where(F.col(at) >= F.col("now") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("now")


def turns_of_lanes(waiting: DataFrame, worker: list[str], is_query: Column, order: list[str]) -> DataFrame:
    """Adds ``turn``: what waits for each worker in the order it is served; queries go before bulk, each as it came."""
    w = Window.partitionBy(*worker).orderBy(is_query.desc(), *order)
    return waiting.withColumn("turn", F.row_number().over(w))


def fair_lane(spark, lane: str) -> None:
    """Run what this thread starts next in a lane of its own; with spark.scheduler.mode=FAIR lanes share the executors."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", lane)


def applied(rows: DataFrame, staged: DataFrame, key: str, text: str, vector: str) -> DataFrame:
    """Rows with the staged vectors whose text is still the row's; without one the vector is cleared."""
    s = staged.select(F.col(key), F.col(text).alias("_text"), F.col(vector).alias("_vec"))
    j = rows.join(s, key, "left")
    return j.withColumn(vector, F.when(F.col(text).eqNullSafe(F.col("_text")), F.col("_vec"))).drop("_text", "_vec")


def active_windows(events: DataFrame, who: str, at: str, minutes: int) -> DataFrame:
    """(who, first, last, n): runs of events with no gap longer than ``minutes``."""
    w = F.session_window(at, f"{minutes} minutes")
    return events.groupBy(who, w).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("session_window")


def retained(events: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    return events.where(F.col(at) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def stream_counts(folder: str, schema: T.StructType, spark, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n): event counts per window of a folder of Parquet files read as a stream, late rows included
    up to ``late``. What is there now is processed; the sink is idempotent by batch."""
    out = storage.folder(spark, "stream")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    agg = source.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    q = agg.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n long, batch int").parquet(f"{out}/data")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def stream_first_seen(folder: str, schema: T.StructType, spark, key: str) -> DataFrame:
    """Each key once, however often and in whatever batch it comes: exactly-once hand-out."""
    out = storage.folder(spark, "stream")
    source = spark.readStream.schema(schema).parquet(folder).select(key).dropDuplicates([key])
    q = source.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{out}/data")
