"""The queries of the problems 1 to 10 and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnstone.llm import components, encode, forest, leaks, names, near, residue, split, truth, turns
from tarnstone.storage import table


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.variant_pairs(table(spark, sf, "people"))


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    return names.link_people(table(spark, sf, "people"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return truth.survivors(table(spark, sf, "memory"))


def p2_supported(spark: SparkSession, sf: str) -> DataFrame:
    return truth.supported_values(table(spark, sf, "memory"))


def _turns(spark: SparkSession, sf: str, pauses: bool) -> DataFrame:
    return turns.speaker_turns(table(spark, sf, "meetings"), table(spark, sf, "meeting_people"), table(spark, sf, "people"), pauses)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, False).select("meeting_id", "turn_no", "person_id")


def p3_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, True)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return components.consolidate(table(spark, sf, "memory"), table(spark, sf, "memory_conflicts"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_pairs(table(spark, sf, "memory"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_groups(table(spark, sf, "memory"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_items(table(spark, sf, "meetings"), table(spark, sf, "chunks"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.cut_kinds(_pieces(spark, sf))


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    vectors = forest.memory_vectors(table(spark, sf, "memory"), table(spark, sf, "reembed_staging"))
    return forest.named(forest.nearest(vectors))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf, "documents"), *_tokenizer("byte_bpe_50k.tiktoken"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "n_chars")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_entities, p2_found, p2_supported, p3_found, p3_turns, p4_found, p5_found, p5_groups, p6_found, p6_pieces, p7_found, p8_ids, p9_found, p9_kept, p10_found)
    return {f.__name__: f for f in found}


_CLEAN = r"regexp_replace(lower({0}), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"

P2_SQL = rf"""
WITH r AS (
  SELECT id, {_CLEAN.format("key")} AS k, superseded_by AS heir, {_CLEAN.format("status")} AS st, {_CLEAN.format("source")} AS so,
         value, tags, reviewed_at, trim(updated_at) AS u
  FROM memory WHERE key IS NOT NULL),
o AS (
  SELECT r.*, EXISTS (SELECT 1 FROM r AS h WHERE h.k = r.k AND h.id = r.heir AND h.id <> r.id) AS gone,
    CASE st WHEN 'active' THEN 0 WHEN 'stale' THEN 1 WHEN 'superseded' THEN 2 ELSE 3 END AS s,
    CASE so WHEN 'manual' THEN 0 WHEN 'imported' THEN 1 WHEN 'distilled' THEN 2 WHEN 'session' THEN 3 WHEN 'claude-auto' THEN 4 ELSE 5 END AS c,
    CASE WHEN regexp_matches(u, '^\d+$') THEN to_timestamp(CAST(u AS BIGINT))
         WHEN regexp_matches(u, '(Z|[+-]\d\d:\d\d)$') THEN TRY_CAST(u AS TIMESTAMPTZ)
         ELSE TRY_CAST(TRY_CAST(u AS TIMESTAMP) || '+00' AS TIMESTAMPTZ) END AS stamp,
    count(*) OVER (PARTITION BY k) AS n
  FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gone, s, c, stamp DESC NULLS LAST, id DESC) AS p FROM o WHERE n > 1),
f AS (
  SELECT k, 'record' AS field, id, p FROM g
  UNION ALL SELECT k, 'value', id, p FROM g WHERE regexp_replace(value, '[\s\p{{Z}}]+', '', 'g') <> ''
  UNION ALL SELECT k, 'tags', id, p FROM g WHERE CASE WHEN json_valid(tags) THEN json_array_length(tags) ELSE 0 END > 0
  UNION ALL SELECT k, 'reviewed_at', id, p FROM g WHERE reviewed_at IS NOT NULL)
SELECT k AS memory_key, field, arg_min(id, p) AS from_id FROM f GROUP BY k, field
"""

P4_SQL = """
WITH RECURSIVE e AS (
  SELECT memory_id AS a, matched_id AS b FROM memory_conflicts
  WHERE memory_id <> matched_id AND (score IS NULL OR score >= 0.7)
    AND memory_id IN (SELECT id FROM memory) AND matched_id IN (SELECT id FROM memory)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, g) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.v)
SELECT CAST(v AS BIGINT) AS memory_id, CAST(min(g) AS BIGINT) AS group_id FROM r GROUP BY v
"""

P5_SQL = r"""
WITH t AS (
  SELECT id, list_distinct(list_filter(string_split_regex(lower(coalesce(key, '') || ' ' || value), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w
  FROM memory WHERE regexp_replace(value, '[\s\p{Z}]+', '', 'g') <> '')
SELECT a.id AS lo_id, b.id AS hi_id FROM t AS a JOIN t AS b ON a.id < b.id AND 10 * len(b.w) >= 7 * len(a.w) AND 10 * len(a.w) >= 7 * len(b.w)
WHERE 17 * len(list_intersect(a.w, b.w)) >= 7 * (len(a.w) + len(b.w)) AND len(a.w) > 0
"""

P6_SQL = r"""
WITH t AS (
  SELECT 'meeting' AS item_kind, id, transcript AS x FROM meetings UNION ALL SELECT 'chunk', id, chunk_text FROM chunks)
SELECT item_kind, id AS item_id,
  CASE WHEN list_max(list_transform(string_split_regex(x, '[ \t\r\n]'), lambda p: length(p))) > 800 THEN 'forced' ELSE 'natural' END AS cut_kind
FROM t WHERE length(x) > 800
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL}
