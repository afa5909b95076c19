"""Predicates, joins, aggregates, windows, orders and set operations over the tables of the knowledge base."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.operators import ordering as O
from tarnstone.operators import predicates as P
from tarnstone.storage import table as T

AS_OF = "2026-03-01"

# -- predicates -------------------------------------------------------------------------------------------------------


@query("prd_01_point_lookup", "SELECT id, name, path FROM repos WHERE id = 7")
def _(s, d):
    return T(s, d, "repos").where("id = 7").select("id", "name", "path")


@query("prd_02_memory_by_key", """
SELECT key, arg_min(id, p) AS id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY (status = 'active') IS TRUE DESC, updated_at DESC NULLS LAST, id DESC) AS p FROM memory) GROUP BY key""")
def _(s, d):
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    return O.first_per(T(s, d, "memory"), ["key"], active.desc(), F.col("updated_at").desc(), F.col("id").desc()).select("key", "id")


@query("prd_03_memory_list", "SELECT id, key FROM memory WHERE status = 'active' AND memory_type = 'project'")
def _(s, d):
    return P.listed(P.listed(T(s, d, "memory"), "status", None, "active"), "memory_type", "project").select("id", "key")


@query("prd_04_todo_list", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O'")
def _(s, d):
    return P.listed(T(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), "status", "O")


@query("prd_05_due_within", "SELECT l_orderkey, count(*) AS due FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1996-02-01' + 14 GROUP BY 1")
def _(s, d):
    return T(s, d, "lineitem").where(P.due_within(F.col("l_shipdate").cast("date"), "1996-02-01", 14)).groupBy("l_orderkey").agg(F.count("*").alias("due"))


@query("prd_06_date_range", """
SELECT id FROM meetings WHERE date_trunc('second', TRY_CAST(CASE WHEN regexp_matches(meeting_date, '^\\d{4}-\\d\\d-\\d\\d') THEN meeting_date END AS TIMESTAMP)) BETWEEN TIMESTAMP '2025-03-01' AND TIMESTAMP '2025-09-30 23:59:59'""")
def _(s, d):
    iso = F.when(F.col("meeting_date").rlike(r"^\d{4}-\d\d-\d\d"), F.col("meeting_date"))
    return T(s, d, "meetings").where(P.in_range(iso, "2025-03-01 00:00:00", "2025-09-30 23:59:59")).select("id")


@query("prd_07_substring", "SELECT id FROM memory WHERE contains(translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'retry_') OR contains(translate(key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'retry_')")
def _(s, d):
    return T(s, d, "memory").where(P.matches_text(["key", "value"], "Retry_")).select("id")


@query("prd_08_post_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01'")
def _(s, d):
    o = P.listed(T(s, d, "orders"), "o_orderstatus", "P")
    return o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_orderpriority")


@query("prd_09_repo_filter", "SELECT id, name FROM repos WHERE contains(lower(name), 'ar')")
def _(s, d):
    return T(s, d, "repos").where(P.repo_name_filter(F.col("name"), "AR")).select("id", "name")


@query("prd_10_missing_vector", "SELECT id FROM memory WHERE embedding IS NULL AND status = 'active'")
def _(s, d):
    return T(s, d, "memory").where("embedding IS NULL AND status = 'active'").select("id")


@query("prd_11_exists", "SELECT EXISTS (SELECT 1 FROM memory WHERE embedding IS NULL AND status = 'active') AS missing")
def _(s, d):
    return T(s, d, "memory").where("embedding IS NULL AND status = 'active'").limit(1).agg((F.count("*") > 0).alias("missing"))


@query("prd_12_in_list", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT item_id FROM eval_items WHERE kind = 'lookup')")
def _(s, d):
    ids = T(s, d, "eval_items").where("kind = 'lookup'").select(F.col("item_id").alias("doc_id"))
    return T(s, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "source")


@query("prd_13_null_safe", "SELECT a.id, b.id AS other FROM people a JOIN people b ON a.name = b.name AND a.id < b.id AND a.email IS NOT DISTINCT FROM b.email AND a.github_username IS NOT DISTINCT FROM b.github_username")
def _(s, d):
    a, b = T(s, d, "people").alias("a"), T(s, d, "people").alias("b")
    on = (F.col("a.name") == F.col("b.name")) & (F.col("a.id") < F.col("b.id")) & F.col("a.email").eqNullSafe(F.col("b.email")) & F.col("a.github_username").eqNullSafe(F.col("b.github_username"))
    return a.join(b, on).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))


@query("prd_14_needs_review", "SELECT id, row_number() OVER (ORDER BY coalesce(reviewed_at, created_at), id) AS place FROM memory WHERE status = 'active' AND (reviewed_at IS NULL OR reviewed_at < TIMESTAMP '2026-03-01' - INTERVAL 90 DAY)")
def _(s, d):
    return O.numbered(P.needs_review(T(s, d, "memory"), AS_OF, 90), F.coalesce("reviewed_at", "created_at"), "id").select("id", "place")


@query("prd_15_active_agents", "SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-29 23:30:00' AND count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-29') = 0")
def _(s, d):
    day = F.lit("2024-01-29").cast("timestamp_ntz")
    seen = T(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"), F.count_if((F.col("event_type") == "error") & (F.col("ts") >= day)).alias("left"))
    return seen.where((F.col("seen") >= F.lit("2024-01-29 23:30:00").cast("timestamp_ntz")) & (F.col("left") == 0)).select("user_id", "seen")


@query("prd_16_scope", "SELECT id FROM repos WHERE path = '/nowhere' OR contains(path, 'src') OR (description IS NULL AND name = 'alder')")
def _(s, d):
    r = T(s, d, "repos")
    return r.where((F.col("path") == "/nowhere") | F.contains("path", F.lit("src")) | P.scope_matches(F.col("description"), F.col("description"), F.col("name"), {"name": "alder"})).select("id")


@query("prd_17_cut_off", """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id <> 0),
f AS (SELECT *, max(score) OVER (PARTITION BY label) AS top FROM s WHERE score >= 0.1)
SELECT vec_id, label, round(score, 6) AS score FROM f WHERE score >= top - 0.05""")
def _(s, d):
    from tarnstone.plans.vectors import similar_to

    e = T(s, d, "embeddings")
    scored = similar_to(e.where("vec_id <> 0"), e.where("vec_id = 0"), "embedding")
    return P.cut_off(scored, ["label"], 0.1, 0.05).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("prd_18_pick_column", "SELECT id, greatest(coalesce(reviewed_at, created_at), created_at) AS stamp FROM memory WHERE greatest(coalesce(reviewed_at, created_at), created_at) >= TIMESTAMP '2026-01-01'")
def _(s, d):
    stamp = F.greatest(F.coalesce("reviewed_at", "created_at"), "created_at")
    return T(s, d, "memory").select("id", stamp.alias("stamp")).where(F.col("stamp") >= F.lit("2026-01-01").cast("timestamp_ntz"))


@query("prd_19_unsafe_root", "SELECT id, path, (len(list_filter(string_split(path, '/'), lambda p: p <> '')) < 3 OR path = '/home/dev' OR starts_with('/home/dev', path || '/')) AS unsafe FROM repos")
def _(s, d):
    return T(s, d, "repos").select("id", "path", P.unsafe_root(F.col("path"), "/home/dev").alias("unsafe"))


@query("prd_20_defaults", "SELECT id, coalesce(nullif(description, ''), name) AS text FROM repos")
def _(s, d):
    return T(s, d, "repos").select("id", F.coalesce(F.nullif("description", F.lit("")), "name").alias("text"))


@query("prd_21_text_cap", "SELECT id, substring(value, 1, 120) AS head FROM memory WHERE value IS NOT NULL")
def _(s, d):
    return T(s, d, "memory").where("value IS NOT NULL").select("id", F.substring("value", 1, 120).alias("head"))


@query("prd_22_model_gate", "SELECT tbl, count(*) AS n FROM reembed_staging WHERE tbl IS NULL OR tbl = 1 GROUP BY tbl")
def _(s, d):
    return T(s, d, "reembed_staging").where(P.model_allows(F.col("tbl").cast("string"), "1")).groupBy("tbl").agg(F.count("*").alias("n"))


@query("prd_23_inside_root", "SELECT id, NOT list_contains(string_split(file_path, '/'), '..') AND starts_with(file_path, 'src/') AS inside FROM chunks")
def _(s, d):
    return T(s, d, "chunks").select("id", P.inside(F.col("file_path"), F.lit("src/")).alias("inside"))


# -- joins ------------------------------------------------------------------------------------------------------------


@query("jon_02_people_of_meetings", "SELECT m.id AS meeting_id, p.id AS person_id, p.name FROM meetings m JOIN (SELECT DISTINCT meeting_id, person_id FROM meeting_people) x ON x.meeting_id = m.id JOIN people p ON p.id = x.person_id")
def _(s, d):
    x = T(s, d, "meeting_people").select("meeting_id", "person_id").distinct()
    p = T(s, d, "people").select(F.col("id").alias("person_id"), "name")
    return T(s, d, "meetings").select(F.col("id").alias("meeting_id")).join(x, "meeting_id").join(p, "person_id").select("meeting_id", "person_id", "name")


@query("jon_03_roles", "SELECT x.meeting_id, p.name, lower(trim(x.role)) AS role FROM meeting_people x JOIN people p ON p.id = x.person_id")
def _(s, d):
    p = T(s, d, "people").select(F.col("id").alias("person_id"), "name")
    return T(s, d, "meeting_people").join(p, "person_id").select("meeting_id", "name", F.lower(F.trim("role")).alias("role"))


@query("jon_04_repo_files", "SELECT r.name, c.file_path, count(*) AS n FROM repos r JOIN chunks c ON c.repo_id = r.id GROUP BY 1, 2")
def _(s, d):
    r = T(s, d, "repos").select(F.col("id").alias("repo_id"), "name")  # fixed size: the planner broadcasts it
    return T(s, d, "chunks").groupBy("repo_id", "file_path").agg(F.count("*").alias("n")).join(r, "repo_id").groupBy("name", "file_path").agg(F.sum("n").alias("n"))


@query("jon_05_active_keys", "SELECT DISTINCT m.key, t.tag FROM memory m, (SELECT id, unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM memory WHERE json_valid(tags)) t WHERE t.id = m.id AND m.status = 'active'")
def _(s, d):
    m = T(s, d, "memory").where("status = 'active'")
    return m.select("key", F.explode(F.from_json("tags", "array<string>")).alias("tag")).distinct()


@query("jon_09_pairs_to_keys", "SELECT a.key AS lo_key, b.key AS hi_key, c.score FROM memory_conflicts c JOIN memory a ON a.id = least(c.memory_id, c.matched_id) JOIN memory b ON b.id = greatest(c.memory_id, c.matched_id) WHERE c.memory_id <> c.matched_id")
def _(s, d):
    m = T(s, d, "memory").select("id", "key")
    c = T(s, d, "memory_conflicts").where("memory_id <> matched_id").select(F.least("memory_id", "matched_id").alias("lo"), F.greatest("memory_id", "matched_id").alias("hi"), "score")
    return c.join(m.select(F.col("id").alias("lo"), F.col("key").alias("lo_key")), "lo").join(m.select(F.col("id").alias("hi"), F.col("key").alias("hi_key")), "hi").select("lo_key", "hi_key", "score")


@query("jon_11_prune_inactive", "SELECT c.id FROM memory_conflicts c LEFT JOIN memory a ON a.id = c.memory_id LEFT JOIN memory b ON b.id = c.matched_id WHERE coalesce(a.status, '') <> 'active' OR coalesce(b.status, '') <> 'active'")
def _(s, d):
    m = T(s, d, "memory").select("id", "status")
    a, b = m.select(F.col("id").alias("memory_id"), F.col("status").alias("sa")), m.select(F.col("id").alias("matched_id"), F.col("status").alias("sb"))
    return T(s, d, "memory_conflicts").join(a, "memory_id", "left").join(b, "matched_id", "left").where("coalesce(sa, '') <> 'active' OR coalesce(sb, '') <> 'active'").select("id")


@query("jon_13_person_match", "SELECT id FROM people p WHERE contains(lower(name), 'vera') OR EXISTS (SELECT 1 FROM meeting_people x WHERE x.person_id = p.id AND lower(trim(x.role)) = 'chair')")
def _(s, d):
    T(s, d, "people").createOrReplaceTempView("jon13_people")
    T(s, d, "meeting_people").createOrReplaceTempView("jon13_roles")
    return s.sql("SELECT id FROM jon13_people p WHERE contains(lower(name), 'vera') OR EXISTS (SELECT 1 FROM jon13_roles x WHERE x.person_id = p.id AND lower(trim(x.role)) = 'chair')")


@query("jon_14_without_host", "SELECT id FROM meetings WHERE id NOT IN (SELECT meeting_id FROM meeting_people WHERE lower(trim(role)) = 'host' AND meeting_id IS NOT NULL)")
def _(s, d):
    listed = T(s, d, "meeting_people").where("lower(trim(role)) = 'host'").select(F.col("meeting_id").alias("id"))
    return T(s, d, "meetings").join(listed, "id", "left_anti").select("id")


@query("jon_15_new_rows", "SELECT a.id FROM people a WHERE NOT EXISTS (SELECT 1 FROM people b WHERE b.id < a.id AND b.name IS NOT DISTINCT FROM a.name AND b.slack_id IS NOT DISTINCT FROM a.slack_id)")
def _(s, d):
    a = T(s, d, "people").select("id", "name", "slack_id")
    b = a.select(F.col("id").alias("bid"), F.col("name").alias("bname"), F.col("slack_id").alias("bslack"))
    return a.join(b, a.name.eqNullSafe(b.bname) & a.slack_id.eqNullSafe(b.bslack) & (b.bid < a.id), "left_anti").select("id")


@query("jon_16_distinct_pairs", "SELECT id FROM memory_conflicts c WHERE NOT EXISTS (SELECT 1 FROM memory_conflicts x WHERE x.score < 0.7 AND least(x.memory_id, x.matched_id) = least(c.memory_id, c.matched_id) AND greatest(x.memory_id, x.matched_id) = greatest(c.memory_id, c.matched_id))")
def _(s, d):
    c = T(s, d, "memory_conflicts").withColumns({"lo": F.least("memory_id", "matched_id"), "hi": F.greatest("memory_id", "matched_id")})
    return c.join(c.where("score < 0.7").select("lo", "hi"), ["lo", "hi"], "left_anti").select("id")


@query("jon_17_retention", "SELECT DISTINCT user_id FROM events e WHERE ts < TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM events k WHERE k.user_id = e.user_id AND k.event_type = 'purchase' AND k.ts >= TIMESTAMP '2024-01-28')")
def _(s, d):
    e = T(s, d, "events")
    keep = e.where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz"))).select("user_id")
    return e.where(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).select("user_id").distinct().join(keep, "user_id", "left_anti")


@query("jon_18_unread_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS unread FROM customer")
def _(s, d):
    n = T(s, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("unread"))
    return T(s, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("unread", F.lit(0)).cast("bigint").alias("unread"))


@query("jon_19_key_to_id", "SELECT a.id, (SELECT max(b.id) FROM memory b WHERE b.key = a.key AND b.status = 'active' AND b.id <> a.id) AS points_to FROM memory a")
def _(s, d):
    m = T(s, d, "memory")
    top = m.where("status = 'active'").groupBy("key").agg(F.max("id").alias("a"), F.max_by("id", F.col("id")).alias("z"), F.sort_array(F.collect_set("id"), False).alias("ids"))
    return m.select("id", "key").join(top, "key", "left").select("id", F.when(F.get("ids", F.lit(0)) == F.col("id"), F.get("ids", F.lit(1))).otherwise(F.get("ids", F.lit(0))).alias("points_to"))


@query("jon_20_coalesced_name", "SELECT e.event_id, coalesce(c.c_name, 'user ' || e.user_id) AS name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_mktsegment = 'BUILDING'")
def _(s, d):
    c = T(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), "c_name")
    return T(s, d, "events").join(c, "user_id", "left").select("event_id", F.coalesce("c_name", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("name"))


@query("jon_22_ancestors", "WITH p AS (SELECT file_path AS path FROM chunks UNION SELECT regexp_extract(file_path, '^[^/]+/[^/]+') FROM chunks UNION SELECT path FROM repos) SELECT a.path AS parent, b.path AS child FROM p a JOIN p b ON starts_with(b.path, a.path || '/')")
def _(s, d):
    # an equi-join on every ancestor of a path instead of comparing all pairs
    c = T(s, d, "chunks")
    r = c.select(F.col("file_path").alias("path")).union(c.select(F.regexp_extract("file_path", "^[^/]+/[^/]+", 0))).union(T(s, d, "repos").select("path")).distinct()
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    child = r.select(F.col("path").alias("child"), F.explode(F.when(F.size(parts) > 1, ups)).alias("parent"))
    return child.join(r.select(F.col("path").alias("parent")), "parent").select("parent", "child")


@query("jon_23_nearest_cover", "SELECT c.file_path, max(length(p.p)) AS depth FROM (SELECT DISTINCT file_path FROM chunks) c LEFT JOIN (SELECT DISTINCT regexp_extract(file_path, '^[^/]+/[^/]+') AS p FROM chunks) p ON starts_with(c.file_path, p.p || '/') GROUP BY 1")
def _(s, d):
    f = T(s, d, "chunks").select("file_path").distinct()
    roots = T(s, d, "chunks").select(F.regexp_extract("file_path", "^[^/]+/[^/]+", 0).alias("p")).distinct()
    parts = F.split("file_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = f.select("file_path", F.explode_outer(F.when(F.size(parts) > 1, ups)).alias("p"))
    return up.join(roots.withColumn("n", F.length("p")), "p", "left").groupBy("file_path").agg(F.max("n").cast("bigint").alias("depth"))


# -- aggregates -------------------------------------------------------------------------------------------------------


@query("agg_01_counts", "SELECT repo_id, count(DISTINCT file_path) AS files, count(*) AS chunks FROM chunks GROUP BY repo_id")
def _(s, d):
    per = T(s, d, "chunks").groupBy("repo_id", "file_path").agg(F.count("*").alias("n"))
    return per.groupBy("repo_id").agg(F.count("file_path").alias("files"), F.sum("n").alias("chunks"))


@query("agg_02_best_chunk", """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT label, round(max(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[])), 6) AS score FROM embeddings, q WHERE vec_id <> 0 GROUP BY label""")
def _(s, d):
    from tarnstone.plans.vectors import similar_to

    e = T(s, d, "embeddings")
    return similar_to(e.where("vec_id <> 0"), e.where("vec_id = 0"), "embedding").groupBy("label").agg(F.round(F.max("score"), 6).alias("score"))


@query("agg_03_scope_class", "SELECT repo_id, max(CASE WHEN ends_with(file_path, '.rs') THEN 1 ELSE 0 END) AS here, max(CASE WHEN ends_with(file_path, '.md') THEN 1 ELSE 0 END) AS docs FROM chunks GROUP BY repo_id")
def _(s, d):
    has = lambda e: F.max(F.endswith("file_path", F.lit(e)).cast("int"))
    return T(s, d, "chunks").groupBy("repo_id").agg(has(".rs").alias("here"), has(".md").alias("docs"))


@query("agg_04_need_vectors", "SELECT memory_type, count(*) FILTER (embedding IS NULL AND status = 'active') AS missing FROM memory GROUP BY memory_type")
def _(s, d):
    return T(s, d, "memory").groupBy("memory_type").agg(F.count_if(F.col("embedding").isNull() & (F.col("status") == "active")).alias("missing"))


@query("agg_05_file_done", "SELECT repo_id, file_path, count(*) FILTER (context IS NULL) = 0 AS done FROM chunks GROUP BY 1, 2")
def _(s, d):
    return T(s, d, "chunks").groupBy("repo_id", "file_path").agg((F.count_if(F.col("context").isNull()) == 0).alias("done"))


@query("agg_06_resume_point", "SELECT tbl, max(id) AS last_id, count(*) AS n FROM reembed_staging GROUP BY tbl")
def _(s, d):
    return T(s, d, "reembed_staging").groupBy("tbl").agg(F.max("id").alias("last_id"), F.count("*").alias("n"))


@query("agg_07_ordered_concat", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def _(s, d):
    return T(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ", ").alias("names"))


@query("agg_08_window_count", "SELECT count(*) AS n FROM events WHERE event_type IN ('error', 'view') AND ts >= TIMESTAMP '2024-01-29 23:00:00'")
def _(s, d):
    return T(s, d, "events").where(F.col("event_type").isin("error", "view") & (F.col("ts") >= F.lit("2024-01-29 23:00:00").cast("timestamp_ntz"))).agg(F.count("*").alias("n"))


@query("agg_09_distinct", "SELECT DISTINCT lang, kind FROM documents")
def _(s, d):
    return T(s, d, "documents").select("lang", "kind").distinct()


@query("agg_11_token_overlap", """
WITH t AS (SELECT m.id, c.matched_id, list_distinct(list_filter(string_split_regex(translate(m.value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')) AS a,
 list_distinct(list_filter(string_split_regex(translate(o.value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')) AS b
 FROM (SELECT DISTINCT memory_id, matched_id FROM memory_conflicts) c JOIN memory m ON m.id = c.memory_id JOIN memory o ON o.id = c.matched_id WHERE m.value IS NOT NULL AND o.value IS NOT NULL)
SELECT id, matched_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS overlap FROM t""")
def _(s, d):
    from tarnstone.functions.text import overlap_ratio, simple_tokens

    m = T(s, d, "memory").where("value IS NOT NULL").select("id", F.array_distinct(simple_tokens("value")).alias("w"))
    c = T(s, d, "memory_conflicts").select("memory_id", "matched_id").distinct()
    a, b = m.select(F.col("id").alias("memory_id"), F.col("w").alias("a")), m.select(F.col("id").alias("matched_id"), F.col("w").alias("b"))
    return c.join(a, "memory_id").join(b, "matched_id").select(F.col("memory_id").alias("id"), "matched_id", F.round(overlap_ratio(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("agg_12_best_probe", "SELECT k, max(score) AS score, arg_max(m, (score, -m)) AS via FROM (SELECT least(memory_id, matched_id) AS k, greatest(memory_id, matched_id) AS m, score FROM memory_conflicts WHERE score IS NOT NULL AND matched_id IS NOT NULL) GROUP BY k")
def _(s, d):
    c = T(s, d, "memory_conflicts").where("score IS NOT NULL AND matched_id IS NOT NULL").select(F.least("memory_id", "matched_id").alias("k"), F.greatest("memory_id", "matched_id").alias("m"), "score")
    return c.groupBy("k").agg(F.max("score").alias("score"), F.max_by("m", F.struct("score", -F.col("m"))).alias("via"))


@query("agg_13_oldest_root", "SELECT source, arg_min(doc_id, (created_at, doc_id)) AS root FROM documents WHERE created_at IS NOT NULL GROUP BY source")
def _(s, d):
    return T(s, d, "documents").where("created_at IS NOT NULL").groupBy("source").agg(F.min(F.struct("created_at", "doc_id"))["doc_id"].alias("root"))


@query("agg_14_type_counts", "SELECT 'memory' AS type, count(*) AS n FROM memory UNION ALL SELECT 'people', count(*) FROM people UNION ALL SELECT 'meetings', count(*) FROM meetings UNION ALL SELECT 'chunks', count(*) FROM chunks")
def _(s, d):
    out = None
    for t in ("memory", "people", "meetings", "chunks"):
        n = T(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("type"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("agg_16_group_means", "SELECT coalesce(kind, 'all') AS grp, round(avg(length(text)), 6) AS mean, count(*) AS n FROM eval_items GROUP BY GROUPING SETS ((kind), ())")
def _(s, d):
    e = T(s, d, "eval_items").withColumn("n_chars", F.char_length("text"))
    return e.groupingSets([["kind"], []], "kind").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.count("*").alias("n")).select(F.coalesce("kind", F.lit("all")).alias("grp"), "mean", "n")


@query("agg_17_pool", "SELECT label, count(DISTINCT r) AS rankers, min(p) AS best FROM (SELECT o_custkey AS label, o_orderpriority AS r, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) WHERE p <= 50 GROUP BY label")
def _(s, d):
    o = O.first_per(T(s, d, "orders"), ["o_orderpriority"], F.col("o_totalprice").desc(), F.col("o_orderkey"), n=50, rank="p")
    return o.groupBy(F.col("o_custkey").alias("label")).agg(F.count_distinct("o_orderpriority").alias("rankers"), F.min("p").cast("bigint").alias("best"))


@query("agg_19_left_over", "SELECT user_id, count(*) AS unread, greatest(count(*) - 5, 0) AS left_over FROM events WHERE event_type = 'view' GROUP BY user_id")
def _(s, d):
    n = F.count("*")
    return T(s, d, "events").where("event_type = 'view'").groupBy("user_id").agg(n.alias("unread"), F.greatest(n - 5, F.lit(0)).alias("left_over"))


# -- windows and orders -----------------------------------------------------------------------------------------------


@query("win_01_position", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def _(s, d):
    return T(s, d, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("position"))


@query("win_02_rank_in_type", "SELECT kind, doc_id, p AS place FROM (SELECT kind, doc_id, row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC NULLS LAST, doc_id) AS p FROM documents) WHERE p <= 20")
def _(s, d):
    return O.first_per(T(s, d, "documents"), ["kind"], F.col("n_chars").desc(), F.col("doc_id"), n=20, rank="place").select("kind", "doc_id", F.col("place").cast("bigint").alias("place"))


@query("win_04_best_of_type", "SELECT doc_id FROM (SELECT doc_id, n_chars, max(n_chars) OVER (PARTITION BY kind) AS m FROM documents) WHERE n_chars >= m - 4000")
def _(s, d):
    m = T(s, d, "documents").groupBy("kind").agg(F.max("n_chars").alias("m"))
    return T(s, d, "documents").join(m, "kind").where("n_chars >= m - 4000").select("doc_id")


@query("win_05_token_budget", """
WITH t AS (SELECT source, doc_id, row_number() OVER w AS p, sum(ceil(octet_length(encode(text)) / 4)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM t WHERE p = 1 OR used <= 2000""")
def _(s, d):
    t = T(s, d, "documents").where("text IS NOT NULL")
    size = F.ceil(F.octet_length("text") / 4)
    return O.within_budget(t, ["source"], [F.col("doc_id")], size, 2000).select("source", "doc_id", F.col("used").cast("bigint").alias("used"))


@query("win_06_mail_budget", """
WITH t AS (SELECT meeting_id, id, row_number() OVER w AS p, sum(length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT repo_id AS meeting_id, id, chunk_text AS body FROM chunks) WINDOW w AS (PARTITION BY meeting_id ORDER BY id))
SELECT meeting_id AS mailbox, id FROM t WHERE p = 1 OR used <= 4000""")
def _(s, d):
    m = T(s, d, "chunks").select(F.col("repo_id").alias("mailbox"), "id", F.col("chunk_text").alias("body"))
    return O.unread_budget(m, "mailbox", 4000).select("mailbox", "id")


@query("win_07_top_lines", "SELECT repo_id, file_path, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY length(chunk_text) DESC, id) AS p FROM chunks) WHERE p <= 3")
def _(s, d):
    return O.first_per(T(s, d, "chunks"), ["repo_id", "file_path"], F.char_length("chunk_text").desc(), F.col("id"), n=3).select("repo_id", "file_path", "id")


@query("win_08_partial_cap", "SELECT id FROM (SELECT id, contains(name, 'an') AS part, row_number() OVER (PARTITION BY contains(name, 'an') ORDER BY id) AS p FROM people WHERE contains(name, 'a')) WHERE NOT part OR p <= 10")
def _(s, d):
    h = T(s, d, "people").where(F.contains("name", F.lit("a"))).select("id", F.contains("name", F.lit("an")).alias("part"))
    # only the capped side needs an order: a bounded top list; the other passes through
    return h.where("NOT part").select("id").unionByName(h.where("part").orderBy("id").limit(10).select("id"))


@query("win_13_successor", "SELECT a.id, b.key AS next_key FROM memory a LEFT JOIN memory b ON b.id = a.superseded_by AND b.id <> a.id")
def _(s, d):
    m = T(s, d, "memory").select("id", "key", F.col("superseded_by").cast("bigint").alias("heir"))
    b = m.select(F.col("id").alias("heir"), F.col("key").alias("next_key"))
    return m.join(b, (m.heir == b.heir) & (m.id != b.heir), "left").select("id", "next_key")


@query("srt_01_todo_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN o_orderdate END ASC NULLS LAST, o_orderdate, o_orderkey) AS place FROM orders")
def _(s, d):
    due = F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))
    w = W.partitionBy("o_custkey").orderBy(due.asc_nulls_last(), "o_orderdate", "o_orderkey")
    return T(s, d, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("srt_02_history_order", "SELECT id, row_number() OVER (PARTITION BY key ORDER BY (status = 'active') IS TRUE DESC, created_at DESC NULLS LAST, id DESC) AS place FROM memory")
def _(s, d):
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    w = W.partitionBy("key").orderBy(active.desc(), F.col("created_at").desc(), F.col("id").desc())
    return T(s, d, "memory").select("id", F.row_number().over(w).cast("bigint").alias("place"))


@query("srt_03_list_head", "SELECT id, title FROM meetings ORDER BY created_at DESC NULLS LAST, id LIMIT 25")
def _(s, d):
    return T(s, d, "meetings").orderBy(F.col("created_at").desc(), "id").limit(25).select("id", "title")


@query("srt_10_match_class", "SELECT id, CASE WHEN name = 'Vera' THEN 0 WHEN lower(name) = 'vera' THEN 1 WHEN starts_with(lower(name), 'vera') THEN 2 WHEN contains(lower(name), 'vera') THEN 3 ELSE 4 END AS class FROM people WHERE contains(lower(name), 'vera') OR contains(lower(notes), 'vera')")
def _(s, d):
    from tarnstone.plans.code import match_class

    p = T(s, d, "people").where(F.contains(F.lower("name"), F.lit("vera")) | F.contains(F.lower("notes"), F.lit("vera")))
    return p.select("id", match_class(F.col("name"), "Vera").alias("class"))


@query("srt_12_history_head", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 40")
def _(s, d):
    return T(s, d, "events").orderBy(F.col("event_id").desc()).limit(40).select("event_id")


@query("srt_15_longest_tokens", """
SELECT id, array_to_string(list_transform(list_slice(list_sort(list_transform(w, lambda x: {'n': -length(x), 'w': x})), 1, 8), lambda x: x.w), ' ') AS probe
FROM (SELECT id, list_distinct(list_filter(string_split_regex(translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM memory WHERE value IS NOT NULL)""")
def _(s, d):
    from tarnstone.functions.text import simple_tokens

    by = F.array_sort(F.transform(F.array_distinct(simple_tokens("value")), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    return T(s, d, "memory").where("value IS NOT NULL").select("id", F.array_join(F.transform(F.slice(by, 1, 8), lambda x: x["w"]), " ").alias("probe"))


# -- sets -------------------------------------------------------------------------------------------------------------


@query("set_01_tiers", """
WITH t AS (SELECT id, 0 AS tier FROM people WHERE name = 'Vera' UNION ALL SELECT id, 1 FROM people WHERE contains(lower(name), 'vera') UNION ALL SELECT id, 2 FROM people WHERE contains(lower(notes), 'vera'))
SELECT id, min(tier) AS tier FROM t GROUP BY id""")
def _(s, d):
    p = T(s, d, "people")
    hit = lambda c: p.where(c).select("id", F.col("id").alias("place"))
    return O.tiers([hit(F.col("name") == "Vera"), hit(F.contains(F.lower("name"), F.lit("vera"))), hit(F.contains(F.lower("notes"), F.lit("vera")))], "id").select("id", "tier")


@query("set_02_except", "SELECT id FROM memory WHERE contains(value, 'index') EXCEPT SELECT id FROM memory WHERE contains(key, 'index')")
def _(s, d):
    m = T(s, d, "memory")
    return m.where(F.contains("value", F.lit("index"))).select("id").join(m.where(F.contains("key", F.lit("index"))).select("id"), "id", "left_anti")


@query("set_03_union_all", "SELECT 0 AS type_order, id FROM memory WHERE contains(key, 'cache') UNION ALL SELECT 2, id FROM meetings WHERE contains(title, 'retro') UNION ALL SELECT 6, id FROM repos")
def _(s, d):
    a = T(s, d, "memory").where(F.contains("key", F.lit("cache"))).select(F.lit(0).alias("type_order"), "id")
    b = T(s, d, "meetings").where(F.contains("title", F.lit("retro"))).select(F.lit(2).alias("type_order"), "id")
    return a.unionByName(b).unionByName(T(s, d, "repos").select(F.lit(6).alias("type_order"), "id"))


@query("set_04_insert_ignore", "SELECT meeting_id, person_id, min(coalesce(role, '')) AS role FROM meeting_people GROUP BY 1, 2")
def _(s, d):
    return T(s, d, "meeting_people").groupBy("meeting_id", "person_id").agg(F.min(F.coalesce("role", F.lit(""))).alias("role"))


@query("set_05_insert_replace", "SELECT meeting_id, person_id, coalesce(CASE WHEN lower(trim(max(role))) = 'chair' THEN 'host' END, max(role)) AS role FROM meeting_people GROUP BY 1, 2")
def _(s, d):
    old = T(s, d, "meeting_people").groupBy("meeting_id", "person_id").agg(F.max("role").alias("role"))
    new = old.where("lower(trim(role)) = 'chair'").withColumn("role", F.lit("host"))
    return old.join(new.select("meeting_id", "person_id"), ["meeting_id", "person_id"], "left_anti").unionByName(new)


@query("set_07_seen_keys", "SELECT k, min(id) AS id FROM (SELECT lower(trim(key)) AS k, id FROM memory) GROUP BY k")
def _(s, d):
    return T(s, d, "memory").groupBy(F.lower(F.trim("key")).alias("k")).agg(F.min("id").alias("id"))


@query("set_08_relevant", """
WITH t AS (SELECT id, 0 AS tier FROM memory WHERE status = 'active' AND memory_type = 'feedback' AND reviewed_at IS NOT NULL UNION ALL SELECT id, 1 FROM memory WHERE status = 'active' AND contains(key, 'deploy') UNION ALL SELECT id, 2 FROM memory WHERE status = 'active' AND memory_type = 'project'),
u AS (SELECT id, min(tier) AS tier FROM t GROUP BY id)
SELECT id, tier FROM u ORDER BY tier, id DESC LIMIT 30""")
def _(s, d):
    m = T(s, d, "memory").where("status = 'active'")
    hit = lambda c: m.where(c).select("id", F.col("id").alias("place"))
    u = O.tiers([hit("memory_type = 'feedback' AND reviewed_at IS NOT NULL"), hit(F.contains("key", F.lit("deploy"))), hit("memory_type = 'project'")], "id")
    return u.orderBy("tier", F.col("id").desc()).limit(30).select("id", "tier")


@query("set_09_compare", "SELECT coalesce(a.source, b.source) AS source, a.n AS before, b.n AS after FROM (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) b ON a.source = b.source WHERE abs(coalesce(a.n, 0) - coalesce(b.n, 0)) > 1")
def _(s, d):
    n = T(s, d, "documents").groupBy("source", (F.col("doc_id") % 2).alias("h")).agg(F.count("*").alias("n"))
    a, b = n.where("h = 0").select("source", F.col("n").alias("before")), n.where("h = 1").select("source", F.col("n").alias("after"))
    return a.join(b, "source", "full").where("abs(coalesce(before, 0) - coalesce(after, 0)) > 1")
