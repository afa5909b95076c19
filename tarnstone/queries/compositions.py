"""Operators made of several: session context, supersession with its new row, the job runner, usage with its retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.operators import changes as C
from tarnstone.plans import session as SE
from tarnstone.storage import table as T
from tarnstone.streaming import incremental as I

_FLAT = r"regexp_replace(split_part(value, chr(10), 1), '\s+$', '')"
_RELEVANT = r"""
am AS (SELECT id, key, value, memory_type, created_at AS made, CAST(memory_type = 'feedback' AS INT) AS fb FROM memory WHERE status = 'active' AND memory_type IS NOT NULL AND key IS NOT NULL),
rp AS (SELECT id AS repo, name FROM repos),
cd AS (SELECT repo, id, 0 AS tier FROM (SELECT id, unnest(list_distinct(string_split_regex(lower(key), '[^a-z0-9-]+'))) AS word FROM am WHERE memory_type <> 'session') JOIN rp ON lower(name) = word
 UNION ALL SELECT repo, id, 1 FROM (SELECT id, unnest(list_distinct(string_split_regex(lower(value), '[^a-z0-9-]+'))) AS word FROM am WHERE memory_type IN ('feedback', 'project')) JOIN rp ON lower(name) = word
 UNION ALL SELECT repo, id, 2 FROM rp, (SELECT id FROM am WHERE memory_type = 'feedback' ORDER BY made DESC NULLS LAST, id LIMIT 6)
 UNION ALL SELECT repo, id, 3 FROM rp, (SELECT id FROM am WHERE memory_type = 'project' ORDER BY made DESC NULLS LAST, id LIMIT 6)),
bt AS (SELECT repo, id, min(tier) AS tier FROM cd GROUP BY 1, 2),
uq AS (SELECT * FROM (SELECT bt.*, key, fb, made, row_number() OVER (PARTITION BY repo, key ORDER BY tier, fb DESC, made DESC NULLS LAST, id) AS k FROM bt JOIN am USING (id)) WHERE k = 1),
sl AS (SELECT repo, id, slot FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY tier, fb DESC, made DESC NULLS LAST, id) AS slot FROM uq WHERE fb = 1 AND tier < 3) WHERE slot <= 2),
rv AS (SELECT repo, id, place FROM (SELECT uq.repo, uq.id, row_number() OVER (PARTITION BY uq.repo ORDER BY slot IS NULL, slot, tier, fb DESC, made DESC NULLS LAST, uq.id) AS place FROM uq LEFT JOIN sl ON sl.repo = uq.repo AND sl.id = uq.id) WHERE place <= 6)"""


def _active(s, d):
    return T(s, d, "memory").where("status = 'active' AND memory_type IS NOT NULL AND key IS NOT NULL").select("id", "key", "value", "memory_type", F.col("created_at").alias("at"))


def _repos(s, d):
    return T(s, d, "repos").select(F.col("id").alias("repo"), "name")


@query("cmp_06_relevant_memories", f"WITH {_RELEVANT} SELECT repo, id, place FROM rv")
def _(s, d):
    """Six memories for every repository, two of the places kept for corrections."""
    return SE.relevant_memories(_active(s, d), _repos(s, d), 6, 2)


_BUDGET = 400
_SECTIONS = ("td", "rs", "cf", "re", "se", "ke", "co")


def _head_sql(name: str, title: str, source: str, line: str, order: str, shown: int) -> str:
    return f"{name} AS (SELECT CASE WHEN max(n) > 0 THEN '### {title} (' || max(n) || ')' || chr(10) || string_agg({line}, chr(10) ORDER BY p) || chr(10) || chr(10) END AS t FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS p, count(*) OVER () AS n FROM {source}) WHERE p <= {shown})"


def _page_sql() -> str:
    size = lambda k: f"CAST(ceil(octet_length(encode(coalesce({k}.t, ''))) / 4) AS BIGINT)"
    steps, before = [], "0"
    for k, name in enumerate(_SECTIONS):
        steps.append(f"u{k} AS (SELECT *, {before} + CASE WHEN {before} + s{k} <= {_BUDGET} THEN s{k} ELSE 0 END AS used{k}, {before} + s{k} <= {_BUDGET} AND t{k} <> '' AS k{k} FROM {'sz' if k == 0 else f'u{k - 1}'})")
        before = f"used{k}"
    cols = ", ".join(f"coalesce({n}.t, '') AS t{k}, {size(n)} AS s{k}" for k, n in enumerate(_SECTIONS))
    shown = ", ".join(f"CASE WHEN k{k} THEN '{k + 1}' END" for k in range(len(_SECTIONS)))
    text = " || ".join(f"CASE WHEN k{k} THEN t{k} ELSE '' END" for k in range(len(_SECTIONS)))
    return f"""sz AS (SELECT rp.repo, {cols} FROM rp LEFT JOIN re ON re.repo = rp.repo LEFT JOIN ke ON ke.repo = rp.repo, td, rs, cf, se, co), {', '.join(steps)}
SELECT repo, array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ',') AS shown, md5({text}) AS page FROM u{len(_SECTIONS) - 1}"""


_DOC = "(SELECT doc_id, title, created_at FROM documents WHERE kind = '{0}' AND title IS NOT NULL)"
_PAIRS = "(SELECT c.id, a.key AS ka, b.key AS kb FROM memory_conflicts c JOIN memory a ON a.id = c.memory_id AND a.status = 'active' AND a.key IS NOT NULL JOIN memory b ON b.id = c.matched_id AND b.status = 'active' AND b.key IS NOT NULL WHERE c.score >= 0.9)"


@query("cmp_05_session_context", f"""
WITH {_RELEVANT},
{_head_sql('td', 'Open todos', _DOC.format('todo'), "'- #' || doc_id || ' ' || title", 'created_at NULLS LAST, doc_id', 5)},
{_head_sql('rs', 'Open research', _DOC.format('investigation'), "'- #' || doc_id || ' ' || title", 'created_at DESC NULLS LAST, doc_id', 3)},
{_head_sql('cf', 'Memory conflicts', _PAIRS, "'- ' || ka || ' vs ' || kb", 'id', 5)},
{_head_sql('se', 'Recent sessions', "(SELECT * FROM am WHERE memory_type = 'session')", f"'- ' || key || ': ' || left({_FLAT}, 100)", 'made DESC NULLS LAST, id', 3).replace("left(", "coalesce(left(").replace(", 100)", ", 100), '')")},
re AS (SELECT repo, '### Relevant knowledge (' || count(*) || ')' || chr(10) || string_agg('- [' || memory_type || '] ' || key || ': ' || coalesce(left({_FLAT}, 200), ''), chr(10) ORDER BY place) || chr(10) || chr(10) AS t FROM rv JOIN am USING (id) GROUP BY repo),
ke AS (SELECT repo, '### More memory keys (' || count(*) || ')' || chr(10) || string_agg(key, chr(10) ORDER BY p) || chr(10) || chr(10) AS t FROM (SELECT rp.repo, a.key, row_number() OVER (PARTITION BY rp.repo ORDER BY a.p) AS p FROM rp, (SELECT id, key, row_number() OVER (ORDER BY made DESC NULLS LAST, id) AS p FROM am WHERE memory_type <> 'session' ORDER BY p LIMIT 26) a WHERE NOT EXISTS (SELECT 1 FROM rv JOIN am x USING (id) WHERE rv.repo = rp.repo AND x.key = a.key)) WHERE p <= 20 GROUP BY repo),
co AS (SELECT '### Code index (' || count(*) || ')' || chr(10) || 'repositories' || chr(10) || chr(10) AS t FROM repos), {_page_sql()}""")
def _(s, d):
    """The page of each repository: seven sections, each whole or not at all."""
    active, repos = _active(s, d), _repos(s, d)
    doc = T(s, d, "documents").where("title IS NOT NULL")
    title = F.concat(F.lit("- #"), F.col("doc_id").cast("string"), F.lit(" "), F.col("title"))
    first = lambda n: F.coalesce(F.substring(F.regexp_replace(F.split("value", "\n")[0], r"\s+$", ""), 1, n), F.lit(""))
    todos = SE.top_lines(doc.where("kind = 'todo'"), [F.col("created_at").asc_nulls_last(), F.col("doc_id")], title, "Open todos", 5)
    research = SE.top_lines(doc.where("kind = 'investigation'"), [F.col("created_at").desc_nulls_last(), F.col("doc_id")], title, "Open research", 3)
    m = T(s, d, "memory").where("status = 'active' AND key IS NOT NULL")
    a, b = m.select(F.col("id").alias("memory_id"), F.col("key").alias("ka")), m.select(F.col("id").alias("matched_id"), F.col("key").alias("kb"))
    pairs = T(s, d, "memory_conflicts").where("score >= 0.9").join(a, "memory_id").join(b, "matched_id")
    conflicts = SE.top_lines(pairs, [F.col("id")], F.concat(F.lit("- "), "ka", F.lit(" vs "), "kb"), "Memory conflicts", 5)
    sessions = SE.top_lines(active.where("memory_type = 'session'"), [F.col("at").desc_nulls_last(), F.col("id")], F.concat(F.lit("- "), "key", F.lit(": "), first(100)), "Recent sessions", 3)
    code = T(s, d, "repos").agg(F.concat(F.lit("### Code index ("), F.count("*").cast("string"), F.lit(")\nrepositories\n\n")).alias("text"))

    picked = SE.relevant_memories(active, repos, 6, 2).join(active, "id")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("- ["), "memory_type", F.lit("] "), "key", F.lit(": "), first(200)).alias("line")))), lambda x: x["line"])
    own = picked.groupBy("repo").agg(lines.alias("lines"), F.collect_set("key").alias("keys")).withColumn("relevant", SE.section("Relevant knowledge", F.size("lines"), F.col("lines")))
    # of the latest keys as many as are needed when all shown ones are among them
    latest = active.where("memory_type <> 'session'").orderBy(F.col("at").desc_nulls_last(), "id").limit(26)
    from tarnstone.operators.ordering import numbered

    latest = numbered(latest, F.col("at").desc_nulls_last(), "id", rows=26).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("latest"))
    every = repos.join(own.select("repo", "relevant", "keys"), "repo", "left").crossJoin(latest)  # one row
    others = F.slice(F.filter("latest", lambda k: ~F.array_contains(F.coalesce("keys", F.array().cast("array<string>")), k)), 1, 20)
    every = every.withColumn("others", others).withColumn("more", SE.section("More memory keys", F.size("others"), F.col("others")))
    for name, one in (("todos", todos), ("research", research), ("conflicts", conflicts), ("sessions", sessions), ("code", code)):
        every = every.crossJoin(one.withColumnRenamed("text", name))  # one row each
    shown, text = SE.page([F.col(c) for c in ("todos", "research", "conflicts", "relevant", "sessions", "more", "code")], _BUDGET)
    return every.select("repo", shown.alias("shown"), F.md5(text.cast("binary")).alias("page"))


_SUPERSEDE = """
m AS (SELECT id, key, value, status, source, superseded_by, row_number() OVER (PARTITION BY key ORDER BY (status = 'active') IS TRUE DESC, id DESC) AS k FROM memory WHERE key IS NOT NULL),
ac AS (SELECT id, key, value, source FROM m WHERE k = 1 AND status = 'active'),
gi AS (SELECT a.key AS old_key, arg_max(b.key, b.id) AS new_key, arg_max('merged: ' || coalesce(b.value, ''), b.id) AS new_value FROM ac a JOIN memory b ON b.id = a.id + 1 AND b.key IS NOT NULL WHERE a.id % 7 = 0 GROUP BY a.key),
ok AS (SELECT gi.*, o.id AS old_id, n.id AS new_id, n.value AS before FROM gi JOIN ac o ON o.key = gi.old_key LEFT JOIN ac n ON n.key = gi.new_key WHERE gi.old_key <> gi.new_key AND coalesce(n.source, '') <> 'manual'),
la AS (SELECT new_key, arg_max(new_value, old_id) AS new_value, max(new_id) AS new_id, arg_max(before, old_id) AS before FROM ok GROUP BY new_key)"""


@query("dml_03_supersede", f"""
WITH {_SUPERSEDE}
SELECT 'retired' AS change, old_key AS key, md5(o.value) AS value FROM ok JOIN ac o ON o.id = ok.old_id
UNION ALL SELECT CASE WHEN new_id IS NULL THEN 'added' ELSE 'updated' END, new_key, md5(new_value) FROM la WHERE new_id IS NULL OR before IS DISTINCT FROM new_value
UNION ALL SELECT 'snapshot', new_key, md5(before) FROM la WHERE new_id IS NOT NULL AND before IS DISTINCT FROM new_value""")
def _(s, d):
    """Old keys retired in favour of new ones whose row is added, or updated with a snapshot of what it was. A pair whose old
    key has no active row, whose keys are equal, or whose new key is hand-written changes nothing."""
    m = T(s, d, "memory").where("key IS NOT NULL")
    active = C.active_rows(m).select("id", "key", "value", "source")
    b = m.select((F.col("id") - 1).alias("id"), F.col("id").alias("bid"), F.col("key").alias("new_key"), F.concat(F.lit("merged: "), F.coalesce("value", F.lit(""))).alias("new_value"))
    given = active.where("id % 7 = 0").select("id", F.col("key").alias("old_key")).join(b, "id").groupBy("old_key").agg(F.max_by("new_key", "bid").alias("new_key"), F.max_by("new_value", "bid").alias("new_value"))
    return C.supersede_into(active, given).select("change", "key", F.md5(F.col("value").cast("binary")).alias("value"))


@query("stm_10_job_order", """
WITH j AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, max(ts) OVER (PARTITION BY user_id) AS last, ts FROM events)
SELECT event_id, turn, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'done' END AS state, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS attempts FROM j""")
def _(s, d):
    """Jobs of each worker, oldest first: a failure stops only itself, an interrupted job is queued again."""
    ends = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "interrupted").otherwise("done")
    return I.jobs_run(T(s, d, "events"), "user_id", ["ts", "event_id"], ends).select("event_id", "turn", "state", "attempts")


@query("stm_05_usage_retention", """
WITH n AS (SELECT event_id, user_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' OR event_type = 'purchase'), a AS (SELECT max(ts) AS now FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM n, a WHERE ts >= now - INTERVAL 14 DAY""")
def _(s, d):
    """Usage appended to what was kept, then pruned by age as a write does; ranks from one."""
    e = T(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    recent = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    kept, new = e.where((F.col("event_type") == "purchase") & ~recent), e.where(recent)
    log = I.appended(kept, new, "ts", 14, e.agg(F.max("ts").alias("now")))
    from pyspark.sql import Window as W

    return log.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("rank"))
