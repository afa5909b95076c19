"""Sinks: markdown vault, JSON hits, usage log, staged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.functions.text import key_path


def yaml_field(name: str, c: Column) -> Column:
    """``name: "value"`` or null."""
    esc = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(c.isNotNull(), F.concat(F.lit(f'{name}: "'), esc, F.lit('"')))


def vault_pages(memory: DataFrame) -> DataFrame:
    """(path, content) of a page per active memory, with a head and links to what replaces it."""
    head = F.concat_ws("\n", F.lit("---"), yaml_field("key", F.col("key")), yaml_field("type", F.col("memory_type")), yaml_field("source", F.col("source")), F.lit("---"))
    link = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit("\n\n[["), F.col("superseded_by").cast("bigint").cast("string"), F.lit("]]")))
    body = F.concat(head, F.lit("\n\n"), F.coalesce("value", F.lit("")), F.coalesce(link, F.lit("")), F.lit("\n"))
    return memory.select(F.concat(F.lit("memory/"), key_path("key"), F.lit(".md")).alias("path"), body.alias("content"))


def json_hits(hits: DataFrame) -> DataFrame:
    """One JSON object per hit, in order of place."""
    return hits.select("place", F.to_json(F.struct(*[c for c in hits.columns if c != "place"])).alias("json"))


def usage_rows(searches: DataFrame) -> DataFrame:
    """(event_id, rank, item) of searches (event_id, items ARRAY): ranks from 1."""
    return searches.select("event_id", F.posexplode("items").alias("p", "item")).select("event_id", (F.col("p") + 1).alias("rank"), "item")


def write_partitioned(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Parquet in folders by key, one file a task and key: later scans of a key read its folder only."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(folder)
