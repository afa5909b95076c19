"""Changes of records, incremental operators, evaluation, sources, sinks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.functions import text as X
from tarnstone.operators import changes as C
from tarnstone.operators import ordering as O
from tarnstone.plans import evaluation as E
from tarnstone.queries.relational import AS_OF
from tarnstone.sources import readers as R
from tarnstone.sources import sinks as K
from tarnstone.storage import table as T
from tarnstone.streaming import incremental as I

# -- changes ----------------------------------------------------------------------------------------------------------

_ACTIVE = "SELECT lower(trim(key)) AS key, arg_max(value, id) AS value, arg_max(source, id) AS source, CAST(max(id) AS VARCHAR) AS updated, arg_max(embedding IS NOT NULL, id) AS has_vector FROM memory WHERE status = 'active' GROUP BY 1"
_GIVEN = "SELECT key, arg_max(value, id) AS value, arg_max(source, id) AS source FROM (SELECT id, CASE WHEN id % 3 = 0 THEN lower(trim(key)) ELSE lower(trim(key)) || '-new' END AS key, CASE WHEN id % 2 = 0 THEN value ELSE value || '!' END AS value, 'session' AS source FROM memory WHERE status = 'active' AND value IS NOT NULL) GROUP BY key"


def _active(s, d):
    m = T(s, d, "memory").where("status = 'active'")
    by = lambda c, n: F.max_by(F.struct(c.alias("x")), "id")["x"].alias(n)
    return m.groupBy(F.lower(F.trim("key")).alias("key")).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("id"))).alias("value"), F.max_by("source", F.when(F.col("source").isNotNull(), F.col("id"))).alias("source"), F.max("id").cast("string").alias("updated"), by(F.col("embedding").isNotNull(), "has_vector"))


def _given(s, d):
    m = T(s, d, "memory").where("status = 'active' AND value IS NOT NULL")
    key = F.lower(F.trim("key"))
    rows = m.select("id", F.when(F.col("id") % 3 == 0, key).otherwise(F.concat(key, F.lit("-new"))).alias("key"), F.when(F.col("id") % 2 == 0, F.col("value")).otherwise(F.concat("value", F.lit("!"))).alias("value"), F.lit("session").alias("source"))
    return C.last_given(rows, "key", F.col("id")).drop("id")


@query("dml_01_upsert", f"""
WITH a AS ({_ACTIVE}), g AS ({_GIVEN})
SELECT coalesce(a.key, g.key) AS key, md5(coalesce(g.value, a.value)) AS value, CASE WHEN a.source = 'manual' THEN 'manual' ELSE coalesce(g.source, a.source) END AS source,
 CASE WHEN g.value IS NOT NULL AND a.value IS DISTINCT FROM g.value THEN 'now' ELSE a.updated END AS updated,
 CASE WHEN g.value IS NOT NULL AND a.value IS DISTINCT FROM g.value THEN FALSE ELSE coalesce(a.has_vector, FALSE) END AS has_vector
FROM a FULL JOIN g ON a.key = g.key""")
def _(s, d):
    return C.upsert(_active(s, d), _given(s, d), "key", "now").withColumn("value", F.md5(F.col("value").cast("binary")))


@query("dml_02_snapshots", f"WITH a AS ({_ACTIVE}), g AS ({_GIVEN}) SELECT a.key, md5(a.value) AS value, 'superseded' AS status FROM a JOIN g ON a.key = g.key WHERE a.value IS DISTINCT FROM g.value")
def _(s, d):
    a = _active(s, d)
    return C.snapshots(a, C.upsert(a, _given(s, d), "key", "now"), "key").select("key", F.md5(F.col("value").cast("binary")).alias("value"), "status")


@query("dml_04_stale", "SELECT id, CASE WHEN status = 'active' AND memory_type = 'session' THEN 'stale' ELSE status END AS status, md5(CASE WHEN status = 'active' AND memory_type = 'session' THEN value || chr(10) || '[stale: moved]' ELSE value END) AS value FROM memory WHERE memory_type IS NOT NULL")
def _(s, d):
    m = T(s, d, "memory").where("memory_type IS NOT NULL")
    return C.mark_stale(m, F.col("memory_type") == "session", "moved").select("id", "status", F.md5(F.col("value").cast("binary")).alias("value"))


@query("dml_05_delete_key", "SELECT id FROM memory WHERE key NOT IN (SELECT key FROM memory WHERE id % 10 = 1)")
def _(s, d):
    m = T(s, d, "memory")
    return C.unlinked(m.select("id", "key"), m.where("id % 10 = 1").select("key").distinct(), ["key"]).select("id")


@query("dml_06_conflict_add", "WITH e AS (SELECT least(memory_id, matched_id) AS lo, greatest(memory_id, matched_id) AS hi, score, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS age FROM memory_conflicts WHERE memory_id <> matched_id AND score IS NOT NULL) SELECT lo, hi, arg_min(score, (age, score)) AS score FROM e GROUP BY lo, hi")
def _(s, d):
    c = T(s, d, "memory_conflicts").where("score IS NOT NULL AND matched_id IS NOT NULL").select("id", F.col("memory_id").alias("a"), F.col("matched_id").alias("b"), "score")
    return C.pairs_add(c.where("id % 2 = 0"), c.where("id % 2 = 1"))


@query("dml_07_distinct_pairs", "SELECT DISTINCT least(memory_id, matched_id) AS lo, greatest(memory_id, matched_id) AS hi FROM memory_conflicts WHERE memory_id <> matched_id AND (least(memory_id, matched_id), greatest(memory_id, matched_id)) NOT IN (SELECT (least(memory_id, matched_id), greatest(memory_id, matched_id)) FROM memory_conflicts WHERE score < 0.7 AND matched_id IS NOT NULL)")
def _(s, d):
    c = T(s, d, "memory_conflicts").where("memory_id <> matched_id").select(F.least("memory_id", "matched_id").alias("lo"), F.greatest("memory_id", "matched_id").alias("hi"), "score")
    return C.unlinked(c, c.where("score < 0.7"), ["lo", "hi"]).select("lo", "hi").distinct()


@query("dml_08_open_conflicts", """
SELECT c.id, least(c.memory_id, c.matched_id) AS lo, greatest(c.memory_id, c.matched_id) AS hi, c.score FROM memory_conflicts c JOIN memory a ON a.id = c.memory_id AND a.status = 'active' JOIN memory b ON b.id = c.matched_id AND b.status = 'active'
WHERE c.memory_id <> c.matched_id AND (c.score IS NULL OR c.score >= 0.8) AND (c.memory_id + c.matched_id) % 5 <> 0""")
def _(s, d):
    c = T(s, d, "memory_conflicts").withColumn("matched_id", F.col("matched_id").cast("bigint"))
    apart = c.where("(memory_id + matched_id) % 5 = 0").select(F.least("memory_id", "matched_id").alias("lo"), F.greatest("memory_id", "matched_id").alias("hi"))
    return C.open_conflicts(c, T(s, d, "memory"), apart, 0.8)


@query("dml_09_finish", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN chr(10) || 'Resolved: shipped' END AS notes FROM orders")
def _(s, d):
    o = T(s, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("closed"))
    return C.finish(o, F.col("o_orderpriority") == "1-URGENT", "F", "shipped", AS_OF).select("o_orderkey", "status", "notes")


@query("dml_11_partial_update", "SELECT p.id, coalesce(q.name, p.name) AS name, coalesce(q.email, p.email) AS email FROM people p LEFT JOIN (SELECT id - 1 AS id, CASE WHEN id % 2 = 0 THEN name END AS name, email FROM people WHERE id % 3 = 0) q USING (id)")
def _(s, d):
    p = T(s, d, "people").select("id", "name", "email")
    patch = p.where("id % 3 = 0").select((F.col("id") - 1).alias("id"), F.when(F.col("id") % 2 == 0, F.col("name")).alias("name"), "email")
    return C.patched(p, patch, "id", ["name", "email"])


@query("dml_13_link_once", "SELECT meeting_id, person_id FROM meeting_people UNION SELECT meeting_id + 1, person_id FROM meeting_people")
def _(s, d):
    l = T(s, d, "meeting_people").select("meeting_id", "person_id").distinct()
    return C.linked(l, l.select((F.col("meeting_id") + 1).alias("meeting_id"), "person_id"), ["meeting_id", "person_id"])


@query("dml_14_replace_chunks", "SELECT repo_id, file_path, chunk_index FROM chunks WHERE repo_id <> 2 UNION ALL SELECT 2, 'all.md', id FROM chunks WHERE repo_id = 2")
def _(s, d):
    c = T(s, d, "chunks").select("repo_id", "file_path", "chunk_index", "id")
    new = c.where("repo_id = 2").select("repo_id", F.lit("all.md").alias("file_path"), F.col("id").alias("chunk_index"))
    return C.replaced_children(c.drop("id"), new, "repo_id")


@query("dml_16_cascade", "SELECT meeting_id, person_id FROM meeting_people WHERE meeting_id IN (SELECT id FROM meetings WHERE transcript IS NOT NULL)")
def _(s, d):
    return C.cascade(T(s, d, "meeting_people"), T(s, d, "meetings").where("transcript IS NOT NULL"), "meeting_id", "id").select("meeting_id", "person_id")


@query("dml_18_hand_out", """
WITH m AS (SELECT id, repo_id AS mailbox, chunk_text AS body, CASE WHEN id % 4 = 0 THEN 1 END AS read_at FROM chunks),
u AS (SELECT id, row_number() OVER w AS p, sum(length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM m WHERE read_at IS NULL WINDOW w AS (PARTITION BY mailbox ORDER BY id))
SELECT m.id, m.read_at IS NULL AND coalesce(u.p = 1 OR u.used <= 3000, FALSE) AS taken FROM m LEFT JOIN u USING (id)""")
def _(s, d):
    m = T(s, d, "chunks").select("id", F.col("repo_id").alias("mailbox"), F.col("chunk_text").alias("body"), F.when(F.col("id") % 4 == 0, 1).alias("read_at"))
    return C.handed_out(m, "mailbox", 3000).select("id", "taken")


@query("dml_19_address", """
WITH a AS (SELECT id, github_username AS name, slack_id AS session FROM people WHERE slack_id IS NOT NULL AND github_username IS NOT NULL),
q AS (SELECT DISTINCT substring(session, 1, 6) AS q FROM a UNION SELECT session FROM a WHERE id % 3 = 0 UNION SELECT name FROM a WHERE id % 5 = 0)
SELECT q.q, coalesce((SELECT min(id) FROM a WHERE name = q.q), (SELECT min(id) FROM a WHERE session = q.q), (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM a WHERE starts_with(session, q.q) AND length(q.q) >= 4)) AS agent FROM q""")
def _(s, d):
    a = T(s, d, "people").where("slack_id IS NOT NULL AND github_username IS NOT NULL").select("id", F.col("github_username").alias("name"), F.col("slack_id").alias("session"))
    q = a.select(F.substring("session", 1, 6).alias("q")).union(a.where("id % 3 = 0").select("session")).union(a.where("id % 5 = 0").select("name")).distinct()
    return C.resolved_address(a, q)


@query("dml_20_job_queue", "SELECT event_type AS state, count(*) AS n FROM events WHERE NOT (event_type = 'purchase' AND ts < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) GROUP BY 1")
def _(s, d):
    e = T(s, d, "events")
    old = (F.col("event_type") == "purchase") & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS"))
    return e.where(~old).groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"))


@query("dml_21_unpivot", "SELECT id, 'email' AS type, email AS identifier FROM people WHERE email <> '' UNION ALL SELECT id, 'slack', slack_id FROM people WHERE slack_id <> '' UNION ALL SELECT id, 'github', github_username FROM people WHERE github_username <> ''")
def _(s, d):
    p = T(s, d, "people").select("id", F.col("email"), F.col("slack_id").alias("slack"), F.col("github_username").alias("github"))
    return p.unpivot("id", ["email", "slack", "github"], "type", "identifier").where("identifier <> ''")


@query("dml_22_unlink", "SELECT DISTINCT meeting_id, person_id FROM meeting_people WHERE NOT (person_id % 2 = 0)")
def _(s, d):
    l = T(s, d, "meeting_people").select("meeting_id", "person_id").distinct()
    return C.unlinked(l, l.where("person_id % 2 = 0"), ["meeting_id", "person_id"])


@query("cmp_08_decision", """
WITH b AS (SELECT memory_id, count(*) AS n, max(score) AS best FROM memory_conflicts WHERE score IS NOT NULL GROUP BY 1)
SELECT m.id, CASE WHEN m.superseded_by IS NOT NULL THEN 'supersede' WHEN coalesce(b.n, 0) = 0 THEN 'insert' WHEN b.best >= 0.93 AND coalesce(m.source, '') <> 'manual' THEN CASE WHEN m.id % 2 = 0 THEN 'supersede match' ELSE 'absorb' END ELSE 'flag' END AS action
FROM memory m LEFT JOIN b ON b.memory_id = m.id""")
def _(s, d):
    b = T(s, d, "memory_conflicts").where("score IS NOT NULL").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"), F.max("score").alias("best"))
    m = T(s, d, "memory").join(b, "id", "left")
    act = C.decision(F.col("superseded_by").isNotNull(), F.coalesce("n", F.lit(0)), F.col("best"), F.coalesce(F.col("source") == "manual", F.lit(False)), 0.93, F.col("id") % 2 == 0)
    return m.select("id", act.alias("action"))


@query("cmp_07_full_records", "SELECT m.id, m.title, count(DISTINCT x.person_id) AS people, string_agg(DISTINCT lower(trim(x.role)), ',' ORDER BY lower(trim(x.role))) AS roles FROM meetings m LEFT JOIN meeting_people x ON x.meeting_id = m.id GROUP BY 1, 2")
def _(s, d):
    x = T(s, d, "meeting_people").groupBy("meeting_id").agg(F.count_distinct("person_id").alias("people"), F.array_join(F.sort_array(F.collect_set(F.lower(F.trim("role")))), ",").alias("roles"))
    m = T(s, d, "meetings").select("id", "title").join(x.withColumnRenamed("meeting_id", "id"), "id", "left")
    return m.select("id", "title", F.coalesce("people", F.lit(0)).cast("bigint").alias("people"), F.nullif("roles", F.lit("")).alias("roles"))


@query("cmp_11_repo_health", "SELECT id, CASE WHEN last_indexed IS NULL THEN 'never indexed' WHEN last_indexed < TIMESTAMP '2025-06-01' THEN 'stale' ELSE 'ok' END AS health FROM repos")
def _(s, d):
    at = F.col("last_indexed")
    return T(s, d, "repos").select("id", F.when(at.isNull(), "never indexed").when(at < F.lit("2025-06-01").cast("timestamp_ntz"), "stale").otherwise("ok").alias("health"))


@query("cmp_12_repo_stats", "SELECT r.id, count(c.id) AS chunks, count(DISTINCT c.file_path) AS files, max(c.last_modified) AS newest FROM repos r LEFT JOIN chunks c ON c.repo_id = r.id GROUP BY r.id")
def _(s, d):
    c = T(s, d, "chunks").groupBy(F.col("repo_id").alias("id")).agg(F.count("id").alias("chunks"), F.count_distinct("file_path").alias("files"), F.max("last_modified").alias("newest"))
    return T(s, d, "repos").select("id").join(c, "id", "left").select("id", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), F.coalesce("files", F.lit(0)).cast("bigint").alias("files"), "newest")


# -- incremental ------------------------------------------------------------------------------------------------------


@query("stm_01_changed_files", """
WITH n AS (SELECT file_path, min(md5(chunk_text)) AS h FROM chunks WHERE repo_id <> 3 GROUP BY 1), o AS (SELECT file_path, max(md5(chunk_text)) AS h FROM chunks WHERE repo_id <> 4 GROUP BY 1)
SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM n FULL JOIN o ON n.file_path = o.file_path WHERE n.h IS DISTINCT FROM o.h""")
def _(s, d):
    h = F.md5(F.col("chunk_text").cast("binary"))
    c = T(s, d, "chunks")
    return I.changed(c.where("repo_id <> 3").groupBy("file_path").agg(F.min(h).alias("h")), c.where("repo_id <> 4").groupBy("file_path").agg(F.max(h).alias("h")), ["file_path"], "h")


@query("stm_02_reused_vectors", """
WITH old AS (SELECT value AS t, min(id) AS id FROM memory WHERE embedding IS NOT NULL AND id % 2 = 0 GROUP BY value)
SELECT m.id, o.id AS vector_of FROM memory m LEFT JOIN old o ON o.t = m.value WHERE m.id % 2 = 1""")
def _(s, d):
    m = T(s, d, "memory").select("id", "value", F.when(F.col("embedding").isNotNull(), F.col("id")).alias("vector_of"))
    return I.reused_vectors(m.where("id % 2 = 1").select("id", "value"), m.where("id % 2 = 0"), "value", "vector_of").select("id", "vector_of")


@query("stm_03_stale_chunks", "SELECT id FROM chunks WHERE context IS DISTINCT FROM file_path AND (context IS NULL OR NOT starts_with(context, 'src'))")
def _(s, d):
    c = T(s, d, "chunks").withColumn("sig", F.when((F.col("context") == F.col("file_path")) | F.startswith("context", F.lit("src")), "now"))
    return I.stale_chunks(c, "now", "sig").select("id")


@query("stm_04_due_sessions", "SELECT user_id, count(*) AS turns FROM events GROUP BY 1 HAVING count(*) >= 5 AND (user_id % 2 = 1 OR count(*) - 30 >= 50)")
def _(s, d):
    marks = s.range(0, 1000, 2).select(F.col("id").alias("user_id"), F.lit(30).cast("bigint").alias("done"))
    return I.due_sessions(T(s, d, "events"), marks, "user_id").select("user_id", "turns")


@query("stm_05_retention", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY GROUP BY 1")
def _(s, d):
    return I.retained(T(s, d, "events"), "ts", "2024-01-30", 14).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stm_06_activity", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 720 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def _(s, d):
    e = T(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    a = I.active_windows(e, "user_id", "at", 720)
    return a.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("stm_07_once", "SELECT DISTINCT user_id FROM events")
def _(s, d):
    import os

    path = f"{d}/events.parquet"
    return I.stream_first_seen(path if os.path.isdir(path) else f"{d}/event[s].parquet", s.read.parquet(path).schema, s, "user_id")


@query("stm_08_staged_apply", "SELECT m.id, CASE WHEN m.value IS NOT DISTINCT FROM g.text AND g.id IS NOT NULL THEN len(g.vec) END AS width FROM memory m LEFT JOIN reembed_staging g ON g.tbl = 0 AND g.id = m.id")
def _(s, d):
    g = T(s, d, "reembed_staging").where("tbl = 0").select("id", "text", F.size("vec").alias("width"))
    m = T(s, d, "memory").select("id", F.col("value").alias("text"))
    j = I.applied(m.withColumn("width", F.lit(None).cast("int")), g, "id", "text", "width")
    return j.select("id", F.col("width").cast("bigint").alias("width"))


@query("stm_09_missing_vectors", "SELECT id FROM chunks WHERE id NOT IN (SELECT id FROM reembed_staging WHERE tbl = 1 AND len(vec) = 384)")
def _(s, d):
    have = T(s, d, "reembed_staging").where((F.col("tbl") == 1) & (F.size("vec") == 384)).select("id")
    return T(s, d, "chunks").join(have, "id", "left_anti").select("id")


@query("stm_stream_windows", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    """Not a feature of the engine this one follows: event-time windows over the event stream."""
    import os

    path = f"{d}/events.parquet"
    c = I.stream_counts(path if os.path.isdir(path) else f"{d}/event[s].parquet", s.read.parquet(path).schema, s)
    return c.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


# -- evaluation -------------------------------------------------------------------------------------------------------

_RES = "res AS (SELECT o_custkey % 40 AS q, o_orderkey % 97 AS label, CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders), top AS (SELECT * FROM res WHERE place <= 30), rel AS (SELECT DISTINCT c_custkey % 40 AS q, c_custkey % 97 AS label FROM customer WHERE c_custkey % 11 = 0)"
_SCORES = f"""
WITH {_RES}, f AS (SELECT q, label, min(place) AS place FROM top GROUP BY 1, 2), t AS (SELECT q, count(*) AS want FROM rel GROUP BY q),
g AS (SELECT q, count(*) FILTER (place <= 5) AS found, min(place) AS best, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg FROM f SEMI JOIN rel USING (q, label) GROUP BY q),
e AS (SELECT t.q, coalesce(found, 0) / want AS recall, coalesce(1 / best, 0) AS rr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(want, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM t LEFT JOIN g ON g.q = t.q)"""


def _results(s, d):
    o = T(s, d, "orders").select((F.col("o_custkey") % 40).alias("q"), (F.col("o_orderkey") % 97).alias("label"), "o_totalprice", "o_orderkey")
    res = O.first_per(o, ["q"], F.col("o_totalprice").desc(), F.col("o_orderkey"), n=30, rank="place").select("q", "label", "place")
    rel = T(s, d, "customer").where("c_custkey % 11 = 0").select((F.col("c_custkey") % 40).alias("q"), (F.col("c_custkey") % 97).alias("label")).distinct()
    return res, rel


@query("evl_02_scores", _SCORES + "SELECT q, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM e")
def _(s, d):
    return E.scores(*_results(s, d)).select("q", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")])


@query("evl_03_tokens_to_first", f"WITH {_RES}, b AS (SELECT q, min(place) AS best FROM top SEMI JOIN rel USING (q, label) GROUP BY q) SELECT top.q, CAST(sum(place * 3) AS BIGINT) AS tokens FROM top JOIN b ON b.q = top.q AND place <= best GROUP BY 1")
def _(s, d):
    res, rel = _results(s, d)
    return E.tokens_to_first(res.withColumn("size", F.col("place") * 3), rel, "size")


@query("evl_04_summary", _SCORES + "SELECT coalesce(CASE WHEN grouping(q % 3) = 1 THEN 'all' END, 'kind ' || (q % 3)) AS grp, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, count(*) AS n FROM e GROUP BY GROUPING SETS ((q % 3), ())")
def _(s, d):
    res, rel = _results(s, d)
    kinds = s.range(40).select(F.col("id").alias("q"), F.concat(F.lit("kind "), (F.col("id") % 3).cast("string")).alias("kind"))
    return E.summary(E.scores(res, rel), kinds, digits=6)


@query("evl_05_bootstrap")
def _(s, d):
    res, rel = _results(s, d)
    e = E.scores(res, rel)
    return E.bootstrap(e.withColumn("diff", F.col("rr") - F.col("recall")), "diff")


@query("evl_08_moved", _SCORES + "SELECT coalesce(a.q, b.q) AS q, a.rr AS before, b.rr AS after FROM (SELECT * FROM e WHERE q < 30) a FULL JOIN (SELECT q, recall AS rr FROM e WHERE q > 4) b ON a.q = b.q WHERE a.rr IS NULL OR b.rr IS NULL OR abs(a.rr - b.rr) > 0.05")
def _(s, d):
    e = E.scores(*_results(s, d))
    return E.moved(e.where("q < 30"), e.where("q > 4").select("q", F.col("recall").alias("rr")), "q", "rr")


# -- sources and sinks ------------------------------------------------------------------------------------------------


@query("src_07_python")
def _(s, d):
    """Definitions in the Python chunks that parse on their own."""
    rows = T(s, d, "chunks").where("chunk_text IS NOT NULL").select(F.concat_ws("#", "file_path", F.col("id").cast("string")).alias("path"), R.language(F.col("file_path")).alias("language"), F.col("chunk_text").alias("text"))
    return R.symbols(rows)


@query("src_12_turn_count", "SELECT count(*) AS turns FROM documents WHERE kind = 'session' AND text IS NOT NULL")
def _(s, d):
    doc = T(s, d, "documents").where("kind = 'session' AND text IS NOT NULL")
    return R.turn_count(doc.select(F.to_json(F.struct(F.lit("user").alias("type"), "doc_id")).alias("value")))


@query("snk_01_insert", "SELECT (SELECT max(id) FROM meetings) + row_number() OVER (ORDER BY id) AS id, title FROM meetings WHERE trim(coalesce(transcript, '')) = ''")
def _(s, d):
    m = T(s, d, "meetings")
    last = m.agg(F.max("id")).first()[0] or 0
    return C.new_ids(m.where("trim(coalesce(transcript, '')) = ''").select(F.col("id").alias("old"), "title"), last, ["old"]).select("id", "title")


@query("snk_02_vault")
def _(s, d):
    """Markdown pages of the active memories."""
    return K.vault_pages(T(s, d, "memory").where("status = 'active'"))


@query("snk_03_json_hits", "SELECT doc_id AS place, json_object('kind', kind, 'source', source) AS json FROM documents")
def _(s, d):
    return K.json_hits(T(s, d, "documents").select(F.col("doc_id").alias("place"), "kind", "source"))


@query("snk_06_usage_ranks", "SELECT id AS event_id, CAST(generate_subscripts(t, 1) AS INTEGER) AS rank, unnest(t) AS item FROM (SELECT id, from_json(tags, '[\"VARCHAR\"]') AS t FROM memory WHERE json_valid(tags) AND json_array_length(tags) > 0)")
def _(s, d):
    m = T(s, d, "memory").where("json_array_length(tags) > 0").select(F.col("id").alias("event_id"), F.from_json("tags", "array<string>").alias("items"))
    return K.usage_rows(m)


# -- small ------------------------------------------------------------------------------------------------------------


@query("msc_01_chunk_sources", "SELECT id, 'notes' AS section, title || ' (notes)' AS head FROM meetings WHERE trim(notes) <> '' UNION ALL SELECT id, 'transcript', title || ' (transcript)' FROM meetings WHERE trim(transcript) <> ''")
def _(s, d):
    m = T(s, d, "meetings")
    secs = F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("text")) for n in ("notes", "transcript")])
    x = m.select("id", "title", F.explode(F.filter(secs, lambda z: F.trim(z["text"]) != "")).alias("x"))
    return x.select("id", "x.section", F.concat("title", F.lit(" ("), F.col("x.section"), F.lit(")")).alias("head"))


@query("msc_03_origin", "SELECT id, CASE source WHEN 'manual' THEN 'hand-written' WHEN 'imported' THEN 'imported' ELSE 'distilled' END AS origin FROM memory")
def _(s, d):
    return T(s, d, "memory").select("id", F.when(F.col("source") == "manual", "hand-written").when(F.col("source") == "imported", "imported").otherwise("distilled").alias("origin"))


@query("msc_06_one_line", "SELECT id, concat_ws(' · ', source, memory_type, status) AS line FROM memory")
def _(s, d):
    return T(s, d, "memory").select("id", F.concat_ws(" · ", "source", "memory_type", "status").alias("line"))


@query("msc_13_need_work", "SELECT bool_or(embedding IS NULL AND status = 'active') AS memory, (SELECT count(*) FROM reembed_staging WHERE len(vec) <> 384) > 0 AS staged FROM memory")
def _(s, d):
    bad = T(s, d, "reembed_staging").agg((F.count_if(F.size("vec") != 384) > 0).alias("staged"))
    return T(s, d, "memory").agg(F.coalesce(F.bool_or(F.col("embedding").isNull() & (F.col("status") == "active")), F.lit(False)).alias("memory")).crossJoin(bad)  # one row each


@query("msc_17_circuit_breaker", "SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY user_id HAVING count(*) >= 3")
def _(s, d):
    e = T(s, d, "events").where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3").select("user_id")


@query("msc_19_labels", "SELECT doc_id, kind || ':' || coalesce(title, '') AS label FROM documents")
def _(s, d):
    return T(s, d, "documents").select("doc_id", F.concat_ws(":", "kind", F.coalesce("title", F.lit(""))).alias("label"))


@query("msc_24_contact_hint", "SELECT id, coalesce(nullif(email, ''), nullif(github_username, ''), slack_id) AS hint FROM people")
def _(s, d):
    return T(s, d, "people").select("id", F.coalesce(F.nullif("email", F.lit("")), F.nullif("github_username", F.lit("")), "slack_id").alias("hint"))


@query("msc_25_link_remove", "SELECT id, list_filter(from_json(tags, '[\"VARCHAR\"]'), lambda t: t <> 'brook') AS tags FROM memory WHERE json_valid(tags)")
def _(s, d):
    m = T(s, d, "memory").where("json_array_length(tags) IS NOT NULL")
    return m.select("id", F.filter(F.from_json("tags", "array<string>"), lambda t: t != "brook").alias("tags"))


@query("src_05_admission", "SELECT id, CASE WHEN octet_length(encode(chunk_text)) > 3000 THEN 'text' WHEN file_path LIKE '%.rs' THEN 'rust' WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.ts' THEN 'typescript' WHEN file_path LIKE '%.go' THEN 'go' WHEN file_path LIKE '%.md' THEN 'markdown' ELSE 'text' END AS language FROM chunks WHERE chunk_text IS NOT NULL AND (octet_length(encode(chunk_text)) <= 3000 OR regexp_matches(file_path, '\\.(rs|py|ts|go|md)$'))")
def _(s, d):
    """Chunks of any length: known languages over the cap are text, others over it are left out."""
    rows = T(s, d, "chunks").where("chunk_text IS NOT NULL").select(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("file_path")).alias("path"), F.octet_length("chunk_text").alias("length"), F.col("chunk_text").cast("binary").alias("content"))
    return R.admitted(rows, 3000).select(F.split("path", ":")[0].cast("bigint").alias("id"), "language")


@query("src_06_language", """
WITH p AS (SELECT id, CASE id % 4 WHEN 0 THEN file_path WHEN 1 THEN regexp_replace(file_path, '\\.[a-z]+$', '.tsx') WHEN 2 THEN regexp_replace(file_path, '\\.[a-z]+$', '') ELSE regexp_replace(file_path, '\\.[a-z]+$', '.lock') END AS path FROM chunks)
SELECT id, CASE WHEN ends_with(path, '.rs') THEN 'rust' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.ts') OR ends_with(path, '.tsx') THEN 'typescript' WHEN ends_with(path, '.md') THEN 'markdown' END AS language FROM p""")
def _(s, d):
    """Known, other known, missing and unknown extensions: each path has one of four."""
    ext = lambda e: F.regexp_replace("file_path", r"\.[a-z]+$", e)
    n = F.col("id") % 4
    path = F.when(n == 0, F.col("file_path")).when(n == 1, ext(".tsx")).when(n == 2, ext("")).otherwise(ext(".lock"))
    return T(s, d, "chunks").select("id", R.language(path).alias("language"))


@query("src_10_markdown_notes", "SELECT 'k' || doc_id AS key, 'reference' AS memory_type, trim(title) AS title, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS value FROM documents WHERE kind = 'readme' AND text IS NOT NULL AND trim(title) <> ''")
def _(s, d):
    doc = T(s, d, "documents").where("kind = 'readme' AND text IS NOT NULL AND trim(title) <> ''")
    page = F.concat(F.lit("---\nname: k"), F.col("doc_id").cast("string"), F.lit("\ntype: reference\ntitle: "), F.col("title"), F.lit("\n---\n"), F.col("text"))
    return R.markdown_notes(doc.select(F.concat(F.lit("notes/n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), page.alias("text")))


@query("src_11_session_turns", """
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, trim(CASE WHEN doc_id % 3 = 0 THEN coalesce(title, '') || ' ' || text ELSE text END, ' ') AS x FROM documents WHERE kind = 'session' AND text IS NOT NULL)
SELECT doc_id AS line, role, substring(x, 1, CASE role WHEN 'user' THEN 500 ELSE 1000 END) AS text FROM t WHERE x <> ''""")
def _(s, d):
    """Turns whose content is a string (also one that starts with a bracket) or a list of blocks."""
    doc = T(s, d, "documents").where("kind = 'session' AND text IS NOT NULL")
    kind = F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant")
    block = lambda k, c: F.struct(F.lit(k).alias("type"), c.alias("text"))
    blocks = F.array(block("text", F.coalesce("title", F.lit(""))), block("tool_use", F.lit("no")), block("text", F.col("text")))
    plain = F.to_json(F.struct(kind.alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(kind.alias("type"), F.struct(blocks.alias("content")).alias("message")))
    return R.session_turns(doc.select(F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 3 == 0, listed).otherwise(plain).alias("value"))).select("line", "role", "text")


@query("mth_05_metrics", _SCORES + "SELECT q, round(recall, 9) AS recall_at_5, round(rr, 9) AS reciprocal_rank, round(ndcg, 9) AS ndcg_at_10 FROM e WHERE recall > 0 OR rr > 0 OR ndcg > 0")
def _(s, d):
    """Recall in five, reciprocal rank and nDCG in ten; a label counts once, where it first stands."""
    e = E.scores(*_results(s, d), k=5, depth=10).where("recall > 0 OR rr > 0 OR ndcg > 0")
    return e.select("q", F.round("recall", 9).alias("recall_at_5"), F.round("rr", 9).alias("reciprocal_rank"), F.round("ndcg", 9).alias("ndcg_at_10"))
