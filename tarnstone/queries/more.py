"""The remaining operators of the inventory."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.functions import text as X
from tarnstone.operators import changes as C
from tarnstone.operators import folds
from tarnstone.operators import ordering as O
from tarnstone.plans import code as K
from tarnstone.plans import evaluation as E
from tarnstone.plans import fulltext as FT
from tarnstone.plans import reports as R
from tarnstone.plans import vectors as V
from tarnstone.queries.lifecycle import _RES, _results
from tarnstone.queries.scalars import low, tok
from tarnstone.queries.search import _LINES, _SIM, _STRICT, DOCS, _scored
from tarnstone.sources import readers as S
from tarnstone.storage import table as T


@query("agg_10_best_per_record", f"WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS p FROM s) SELECT label, vec_id FROM r WHERE p = 1")
def _(s, d):
    return V.best_per_record(_scored(s, d), "label", "vec_id", 1 << 20).select("label", "vec_id")


@query("agg_18_bootstrap")
def _(s, d):
    e = E.scores(*_results(s, d))
    return E.bootstrap(e.withColumn("diff", F.col("ndcg") - F.col("recall")), "diff")


@query("agg_20_pending", "SELECT count(*) AS total, count(*) FILTER (last_indexed IS NULL) AS pending FROM repos")
def _(s, d):
    return T(s, d, "repos").agg(F.count("*").alias("total"), F.count_if(F.col("last_indexed").isNull()).alias("pending"))


@query("win_09_packed", """
WITH RECURSIVE c AS (SELECT repo_id, file_path, id, octet_length(encode(chunk_text)) AS n, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY id) AS k FROM chunks WHERE chunk_text IS NOT NULL),
r AS (SELECT repo_id, file_path, id, k, n AS used, 0 AS pack FROM c WHERE k = 1
 UNION ALL SELECT c.repo_id, c.file_path, c.id, c.k, CASE WHEN r.used + c.n > 2000 THEN c.n ELSE r.used + c.n END, CASE WHEN r.used + c.n > 2000 THEN r.pack + 1 ELSE r.pack END FROM r JOIN c ON c.repo_id = r.repo_id AND c.file_path = r.file_path AND c.k = r.k + 1)
SELECT id, pack FROM r""")
def _(s, d):
    c = T(s, d, "chunks").where("chunk_text IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL").select("repo_id", "file_path", "id", F.octet_length("chunk_text").alias("n"))
    return folds.packed(c, ["repo_id", "file_path"], "id", "n", 2000).select("id", "pack")


#: Greedy suppression in SQL: the rows of a file one after the other, with the ends of those kept so far.
GREEDY = """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY score DESC, id) AS k FROM ({0})),
r AS (SELECT repo_id, file_path, k, [a] AS s, [b] AS e, [id] AS ids FROM o WHERE k = 1
 UNION ALL SELECT repo_id, file_path, k, CASE WHEN ok THEN list_append(s, a) ELSE s END, CASE WHEN ok THEN list_append(e, b) ELSE e END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END
 FROM (SELECT o.repo_id, o.file_path, o.k, o.a, o.b, o.id, r.s, r.e, r.ids, len(list_filter(range(1, len(r.s) + 1), lambda i: o.a <= r.e[i] AND o.b >= r.s[i])) = 0 AS ok FROM r JOIN o ON o.repo_id IS NOT DISTINCT FROM r.repo_id AND o.file_path IS NOT DISTINCT FROM r.file_path AND o.k = r.k + 1)),
f AS (SELECT unnest(ids) AS id FROM r SEMI JOIN (SELECT repo_id, file_path, max(k) AS k FROM o GROUP BY 1, 2) l ON l.repo_id IS NOT DISTINCT FROM r.repo_id AND l.file_path IS NOT DISTINCT FROM r.file_path AND l.k = r.k)
"""


@query("win_10_overlaps", GREEDY.format("SELECT id, repo_id, file_path, start_line AS a, end_line AS b, 1.0::DOUBLE / (chunk_index + 1) AS score FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND start_line <= end_line") + "SELECT id FROM f")
def _(s, d):
    c = T(s, d, "chunks").where("start_line IS NOT NULL AND end_line IS NOT NULL AND start_line <= end_line")
    scored = c.select("id", "repo_id", "file_path", "start_line", "end_line", (1.0 / (F.col("chunk_index") + 1)).alias("score"))
    return V.without_overlaps(scored, ["repo_id", "file_path"], "start_line", "end_line", "id").select("id")


@query("win_11_chunk_index", "SELECT id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS chunk_index, length(unnest(p)) AS n FROM (SELECT id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> '') AS p FROM (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL))")
def _(s, d):
    p = F.filter(F.split("text", "\n\n"), lambda x: x != "")
    t = T(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.posexplode(p).alias("chunk_index", "x"))
    return t.select("id", "chunk_index", F.char_length("x").cast("bigint").alias("n"))


@query("win_12_event_rank", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type = 'purchase'")
def _(s, d):
    w = W.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    return T(s, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("rank"))


@query("win_14_sections", """
WITH RECURSIVE c AS (SELECT o_custkey AS k, o_orderkey AS o, CAST(o_totalprice AS BIGINT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT k, o, i, CASE WHEN n <= 300000 THEN n ELSE 0 END AS used, n <= 300000 AS keep FROM c WHERE i = 1
 UNION ALL SELECT c.k, c.o, c.i, CASE WHEN r.used + c.n <= 300000 THEN r.used + c.n ELSE r.used END, r.used + c.n <= 300000 FROM r JOIN c ON c.k = r.k AND c.i = r.i + 1)
SELECT k, count(*) FILTER (keep) AS shown, sum(o) FILTER (keep) AS ids FROM r GROUP BY k""")
def _(s, d):
    o = T(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.round("o_totalprice").cast("bigint").alias("n"))
    page = R.sections(o, ["k"], "o", "n", 300000)
    total = F.aggregate("shown", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return page.select("k", F.size("shown").cast("bigint").alias("shown"), F.when(F.size("shown") > 0, total).alias("ids"))


@query("srt_05_knn", f"WITH {_SIM} SELECT vec_id FROM s ORDER BY score DESC, vec_id LIMIT 10")
def _(s, d):
    return V.top_k(_scored(s, d), 10, "vec_id").select("vec_id")


@query("srt_06_collapse_first", f"WITH {_SIM} SELECT label, round(max(score), 6) AS score FROM s GROUP BY label ORDER BY max(score) DESC LIMIT 7")
def _(s, d):
    return V.best_per_record(_scored(s, d), "label", "vec_id", 7).select("label", F.round("score", 6).alias("score"))


@query("srt_09_code_rank", f"""
WITH {_LINES}, h AS (SELECT id, line_no, CAST(contains(lower(line), 'store') AS INTEGER) + CAST(contains(lower(line), 'return') AS INTEGER) AS terms, contains(lower(line), 'return store') AS phrase FROM l)
SELECT id, line_no, row_number() OVER (ORDER BY phrase DESC, terms DESC, id, line_no) AS place FROM h WHERE terms > 0 ORDER BY place LIMIT 20""")
def _(s, d):
    h = K.any_term_lines(T(s, d, "chunks"), ["id"], "chunk_text", ["store", "return"])
    both = K.lines(T(s, d, "chunks").where(F.contains(F.lower("chunk_text"), F.lit("return store"))), ["id"], "chunk_text").where(F.contains(F.lower("line"), F.lit("return store"))).select("id", "line_no", F.lit(True).alias("phrase"))
    top = h.join(both, ["id", "line_no"], "left").withColumn("phrase", F.coalesce("phrase", F.lit(False))).orderBy(F.col("phrase").desc(), F.col("terms").desc(), "id", "line_no").limit(20).withColumn("g", F.lit(0))
    return O.first_per(top, ["g"], F.col("phrase").desc(), F.col("terms").desc(), F.col("id"), F.col("line_no"), n=20, rank="place").select("id", F.col("line_no").cast("bigint").alias("line_no"), F.col("place").cast("bigint").alias("place"))


@query("srt_11_any_term_names", "SELECT doc_id, CAST(contains(lower(title), 'queue') AS INTEGER) + CAST(contains(lower(title), 'index') AS INTEGER) AS terms FROM documents WHERE contains(lower(title), 'queue') OR contains(lower(title), 'index') ORDER BY terms DESC, title, doc_id LIMIT 15")
def _(s, d):
    has = lambda t: F.coalesce(F.contains(F.lower("title"), F.lit(t)), F.lit(False)).cast("int")
    t = T(s, d, "documents").select("doc_id", "title", (has("queue") + has("index")).alias("terms")).where("terms > 0")
    return t.orderBy(F.col("terms").desc(), "title", "doc_id").limit(15).select("doc_id", "terms")


@query("srt_16_top_after_cut", f"WITH {_SIM}, m AS (SELECT max(score) AS top FROM s WHERE score >= 0.05) SELECT vec_id FROM s, m WHERE score >= greatest(0.05, top - 0.2) ORDER BY score DESC, vec_id LIMIT 12")
def _(s, d):
    from tarnstone.operators.predicates import cut_off

    return V.top_k(cut_off(_scored(s, d), [], 0.05, 0.2), 12, "vec_id").select("vec_id")


@query("str_07_folded_parts")
def _(s, d):
    """Parts of joined words in titles and chunks of code, folded."""
    words = T(s, d, "chunks").select(F.explode(F.expr(r"regexp_extract_all(chunk_text, '[A-Za-z0-9]*[a-z][A-Z][A-Za-z0-9]*', 0)")).alias("word")).distinct()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(w, X.fold_word(p)) for w in pdf["word"] for p in X.word_parts(w)], columns=["word", "part"])

    return words.mapInPandas(run, "word string, part string").groupBy("part").agg(F.count("*").alias("words"))


@query("str_33_sibling_key", "WITH k AS (SELECT DISTINCT key FROM memory), n AS (SELECT key FROM k UNION SELECT key || '-distilled' FROM k WHERE length(key) % 2 = 0) SELECT k.key, CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.key = k.key || '-distilled') THEN k.key || '-distilled' ELSE k.key || '-distilled-2' END AS sibling FROM k")
def _(s, d):
    k = T(s, d, "memory").select("key").distinct()
    used = k.union(k.where("length(key) % 2 = 0").select(F.concat("key", F.lit("-distilled"))))
    tries = k.select("key", F.posexplode(F.array(F.concat("key", F.lit("-distilled")), F.concat("key", F.lit("-distilled-2")))).alias("p", "sibling"))
    free = tries.join(used.select(F.col("key").alias("sibling")).distinct(), "sibling", "left_anti")
    return free.groupBy("key").agg(F.min_by("sibling", "p").alias("sibling"))


@query("str_34_link_parse", "SELECT id, string_split(path || '|' || name, '|')[1] AS url, string_split(path || '|' || name, '|')[2] AS label FROM repos")
def _(s, d):
    link = F.split(F.concat("path", F.lit("|"), "name"), r"\|", 2)
    return T(s, d, "repos").select("id", link[0].alias("url"), link[1].alias("label"))


@query("str_35_identifier_parse", "SELECT id, 'slack' AS type, slack_id AS value FROM people WHERE slack_id IS NOT NULL")
def _(s, d):
    p = F.split(F.concat(F.lit("slack:"), "slack_id"), ":", 2)
    return T(s, d, "people").where("slack_id IS NOT NULL").select("id", p[0].alias("type"), p[1].alias("value"))


@query("str_38_origin_block", r"SELECT id, '- ' || key || ': ' || substring(trim(regexp_replace(value, '\s+', ' ', 'g')), 1, 240) AS line FROM memory WHERE trim(value) <> '' AND status = 'active'")
def _(s, d):
    m = T(s, d, "memory").where("trim(value) <> '' AND status = 'active'")
    return m.select("id", F.concat(F.lit("- "), "key", F.lit(": "), F.substring(X.squeeze("value"), 1, 240)).alias("line"))


@query("stm_11_date_checkpoint", "SELECT c.repo_id, c.file_path, max(c.last_modified) AS last_modified FROM chunks c JOIN repos r ON r.id = c.repo_id AND c.last_modified > r.last_indexed GROUP BY 1, 2")
def _(s, d):
    mark = T(s, d, "repos").select(F.col("id").alias("repo_id"), "last_indexed")
    return T(s, d, "chunks").join(mark, "repo_id").where("last_modified > last_indexed").groupBy("repo_id", "file_path").agg(F.max("last_modified").alias("last_modified"))


@query("stm_13_crashed_runs", "SELECT user_id, max(ts) FILTER (event_type = 'view') AS started FROM events GROUP BY user_id HAVING max(ts) FILTER (event_type = 'view') > coalesce(max(ts) FILTER (event_type = 'purchase'), TIMESTAMP '2000-01-01')")
def _(s, d):
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts")))
    g = T(s, d, "events").groupBy("user_id").agg(last("view").alias("started"), F.coalesce(last("purchase"), F.lit("2000-01-01").cast("timestamp_ntz")).alias("ended"))
    return g.where("started > ended").select("user_id", "started")


@query("cmp_10_conflict_report", "SELECT a.key AS old_key, count(*) AS n, max(c.score) AS worst FROM memory_conflicts c JOIN memory a ON a.id = c.memory_id WHERE a.status = 'active' GROUP BY 1")
def _(s, d):
    a = T(s, d, "memory").where("status = 'active'").select(F.col("id").alias("memory_id"), F.col("key").alias("old_key"))
    return T(s, d, "memory_conflicts").join(a, "memory_id").groupBy("old_key").agg(F.count("*").alias("n"), F.max("score").alias("worst"))


@query("evl_07_pool", f"WITH {_RES} SELECT label, count(DISTINCT q) AS queries, min(place) AS best FROM top GROUP BY label")
def _(s, d):
    return _results(s, d)[0].groupBy("label").agg(F.count_distinct("q").alias("queries"), F.min("place").alias("best"))


@query("snk_04_labelled", "SELECT id, array_to_string(list_filter(['key: ' || key, CASE WHEN memory_type <> '' THEN 'type: ' || memory_type END, CASE WHEN status <> '' THEN 'status: ' || status END], lambda x: x IS NOT NULL), chr(10)) AS text FROM memory")
def _(s, d):
    return T(s, d, "memory").select("id", R.labelled([("key", F.col("key")), ("type", F.col("memory_type")), ("status", F.col("status"))]).alias("text"))


@query("snk_05_hit_lines", f"WITH {_SIM}, r AS (SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS p FROM s) SELECT printf('%2d. %-12svector %d (%.2f)', p, 'chunk', vec_id, score) AS line FROM r WHERE p <= 9")
def _(s, d):
    top = V.top_k(_scored(s, d), 9, "vec_id").withColumn("g", F.lit(0))
    top = O.first_per(top, ["g"], F.col("score").desc(), F.col("vec_id"), n=9, rank="p")
    return top.select(R.hit_line(F.col("p"), F.lit("chunk"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")), F.col("score")).alias("line"))


@query("snk_07_staged_rows", "SELECT tbl, id, text IS NULL AS empty FROM reembed_staging WHERE id > (SELECT min(id) FROM reembed_staging)")
def _(s, d):
    g = T(s, d, "reembed_staging")
    first = g.agg(F.min("id").alias("first"))
    return g.crossJoin(F.broadcast(first)).where("id > first").select("tbl", "id", F.col("text").isNull().alias("empty"))  # one row


@query("src_03_fan_out", "SELECT c.repo_id, count(*) AS n FROM chunks c JOIN repos r ON r.id = c.repo_id WHERE r.last_indexed IS NOT NULL GROUP BY 1")
def _(s, d):
    live = T(s, d, "repos").where("last_indexed IS NOT NULL").select(F.col("id").alias("repo_id"))
    return T(s, d, "chunks").join(live, "repo_id", "left_semi").groupBy("repo_id").agg(F.count("*").alias("n"))


@query("src_04_indexable", "SELECT id, NOT list_has_any(string_split(file_path, '/'), ['.git', 'node_modules', 'target', '__pycache__', '.venv', 'vendor', 'obj', 'bin']) AS indexable FROM chunks")
def _(s, d):
    return T(s, d, "chunks").select("id", S.indexable(F.col("file_path")).alias("indexable"))


@query("msc_04_store_vector", "SELECT m.id, coalesce(len(g.vec), len(m.embedding)) AS width FROM memory m LEFT JOIN reembed_staging g ON g.tbl = 0 AND g.id = m.id AND m.status = 'active'")
def _(s, d):
    g = T(s, d, "reembed_staging").where("tbl = 0").select("id", F.size("vec").alias("n"))
    m = T(s, d, "memory").select("id", "status", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("old"))
    j = m.join(g, "id", "left")
    return j.select("id", F.coalesce(F.when(F.col("status") == "active", F.col("n")), "old").cast("bigint").alias("width"))


@query("msc_05_memory_detail", "SELECT m.id, count(c.id) AS conflicts, string_agg(DISTINCT CAST(c.matched_id AS VARCHAR), ',' ORDER BY CAST(c.matched_id AS VARCHAR)) AS others FROM memory m LEFT JOIN memory_conflicts c ON c.memory_id = m.id GROUP BY m.id")
def _(s, d):
    c = T(s, d, "memory_conflicts").groupBy(F.col("memory_id").alias("id")).agg(F.count("id").alias("conflicts"), F.sort_array(F.collect_set(F.col("matched_id").cast("bigint").cast("string"))).alias("others"))
    j = T(s, d, "memory").select("id").join(c, "id", "left")
    return j.select("id", F.coalesce("conflicts", F.lit(0)).cast("bigint").alias("conflicts"), F.when(F.size("others") > 0, F.array_join("others", ",")).alias("others"))


@query("msc_09_todo_lines", "SELECT o_orderkey, '[' || CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE ' ' END || '] ' || rpad(o_orderpriority, 16, ' ') || o_orderkey AS line FROM orders")
def _(s, d):
    mark = F.when(F.col("o_orderstatus") == "F", "x").otherwise(" ")
    return T(s, d, "orders").select("o_orderkey", F.concat(F.lit("["), mark, F.lit("] "), F.rpad("o_orderpriority", 16, " "), F.col("o_orderkey").cast("string")).alias("line"))


@query("msc_16_live_locks", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 6 HOUR) AS live, count(*) FILTER (ts < TIMESTAMP '2024-01-30' - INTERVAL 6 HOUR) AS stale FROM events WHERE event_type = 'signup'")
def _(s, d):
    live = F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS")
    return T(s, d, "events").where("event_type = 'signup'").agg(F.count_if(live).alias("live"), F.count_if(~live).alias("stale"))


@query("msc_22_opt_out", "SELECT c.id FROM chunks c LEFT JOIN repos r ON r.id = c.repo_id AND r.description IS NULL WHERE r.id IS NULL")
def _(s, d):
    out = T(s, d, "repos").where("description IS NULL").select(F.col("id").alias("repo_id"))
    return T(s, d, "chunks").join(out, "repo_id", "left_anti").select("id")


@query("msc_23_scoped_elsewhere", f"SELECT id FROM memory WHERE status = 'active' AND NOT starts_with({low('key')}, 'db/')")
def _(s, d):
    m = T(s, d, "memory").where("status = 'active'")
    return C.unlinked(m.select("id"), m.where(F.startswith(X.ascii_lower("key"), F.lit("db/"))), ["id"])


@query("src_16_facts", "SELECT id, key, coalesce(memory_type, 'project') AS type FROM memory WHERE key <> '' AND value <> ''")
def _(s, d):
    """Facts parsed out of replies: one reply of prose around a JSON list per memory."""
    m = T(s, d, "memory").where("key <> '' AND value <> ''")
    reply = F.concat(F.lit("Here it is: "), F.to_json(F.array(F.struct("key", "value", F.col("memory_type").alias("type")))), F.lit(" done"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, f["key"], f["type"]) for i, r in zip(pdf["id"], pdf["reply"], strict=True) for f in S.distilled_facts(r)]
            yield pd.DataFrame(rows, columns=["id", "key", "type"])

    return m.select("id", reply.alias("reply")).mapInPandas(run, "id long, key string, type string")


@query("snk_08_context_page", """
WITH m AS (SELECT memory_type, key, row_number() OVER (PARTITION BY memory_type ORDER BY created_at DESC NULLS LAST, id) AS p FROM memory WHERE status = 'active' AND memory_type IS NOT NULL)
SELECT memory_type, string_agg('- ' || key, chr(10) ORDER BY p) AS page FROM m WHERE p <= 5 GROUP BY memory_type""")
def _(s, d):
    m = T(s, d, "memory").where("status = 'active' AND memory_type IS NOT NULL")
    top = O.first_per(m, ["memory_type"], F.col("created_at").desc(), F.col("id"), n=5, rank="p")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p", "key"))), lambda x: F.concat(F.lit("- "), x["key"]))
    return top.groupBy("memory_type").agg(F.array_join(lines, "\n").alias("page"))


@query("cmp_09_distillation", """
WITH g AS (SELECT key, arg_max(value, id) AS value, max(id) AS id FROM memory WHERE memory_type = 'session' AND value IS NOT NULL GROUP BY key),
a AS (SELECT key, max(id) AS active FROM memory WHERE status = 'active' AND memory_type IS DISTINCT FROM 'session' GROUP BY key),
b AS (SELECT memory_id, count(*) AS n, max(score) AS best FROM memory_conflicts WHERE score IS NOT NULL GROUP BY 1)
SELECT g.key, CASE WHEN a.active IS NOT NULL THEN 'supersede' WHEN coalesce(b.n, 0) = 0 THEN 'insert' WHEN b.best >= 0.97 THEN 'absorb' ELSE 'flag' END AS action
FROM g LEFT JOIN a ON a.key = g.key LEFT JOIN b ON b.memory_id = g.id""")
def _(s, d):
    """One batch of new facts (the session memories): last of each key, candidates, decision."""
    m = T(s, d, "memory")
    g = C.last_given(m.where("memory_type = 'session' AND value IS NOT NULL").select("key", "value", "id"), "key", F.col("id"))
    a = m.where("status = 'active'").where(~F.col("memory_type").eqNullSafe(F.lit("session"))).groupBy("key").agg(F.max("id").alias("active"))
    b = T(s, d, "memory_conflicts").where("score IS NOT NULL").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"), F.max("score").alias("best"))
    j = g.join(a, "key", "left").join(b, "id", "left")
    act = C.decision(F.col("active").isNotNull(), F.coalesce("n", F.lit(0)), F.col("best"), F.lit(False), 0.97, F.lit(False))
    return j.select("key", act.alias("action"))


@query("evl_06_report", f"WITH {_RES}, n AS (SELECT q, count(*) FILTER (place <= 10) AS k, avg(place) AS mean FROM top GROUP BY q) SELECT q, k, round(mean, 3) AS mean FROM n")
def _(s, d):
    return _results(s, d)[0].groupBy("q").agg(F.count_if(F.col("place") <= 10).alias("k"), F.round(F.avg("place"), 3).alias("mean"))


@query("msc_07_oldest_first", "SELECT memory_id, id, row_number() OVER (PARTITION BY memory_id ORDER BY created_at, id) AS position FROM memory_conflicts")
def _(s, d):
    w = W.partitionBy("memory_id").orderBy("created_at", "id")
    return T(s, d, "memory_conflicts").select("memory_id", "id", F.row_number().over(w).cast("bigint").alias("position"))


@query("msc_08_identifiers", "SELECT id, string_agg(t, ',' ORDER BY t) AS types FROM (SELECT id, 'email' AS t FROM people WHERE email <> '' UNION ALL SELECT id, 'github' FROM people WHERE github_username <> '' UNION ALL SELECT id, 'slack' FROM people WHERE slack_id <> '') GROUP BY id")
def _(s, d):
    has = lambda c, n: F.when(F.col(c) != "", F.lit(n))
    types = F.array_compact(F.array(has("email", "email"), has("github_username", "github"), has("slack_id", "slack")))
    return T(s, d, "people").select("id", types.alias("t")).where(F.size("t") > 0).select("id", F.array_join("t", ",").alias("types"))


@query("msc_10_mail_context", """
WITH u AS (SELECT repo_id, id, chunk_text AS body, row_number() OVER w AS p, sum(length(chunk_text)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM chunks WINDOW w AS (PARTITION BY repo_id ORDER BY id))
SELECT repo_id, count(*) FILTER (p = 1 OR used <= 2000) AS shown, count(*) FILTER (NOT (p = 1 OR used <= 2000)) AS left_over FROM u WHERE body IS NOT NULL GROUP BY repo_id""")
def _(s, d):
    m = T(s, d, "chunks").where("chunk_text IS NOT NULL").select(F.col("repo_id").alias("box"), "id", F.col("chunk_text").alias("body"), F.lit(None).cast("int").alias("read_at"))
    out = C.handed_out(m, "box", 2000).groupBy(F.col("box").alias("repo_id")).agg(F.count_if("taken").alias("shown"), F.count_if(~F.col("taken")).alias("left_over"))
    return out


@query("msc_12_reply_route", "SELECT e.event_id, coalesce(c.c_custkey, s.s_suppkey + 100000) AS agent FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal > 0 LEFT JOIN supplier s ON s.s_suppkey = e.user_id")
def _(s, d):
    c = T(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("a"))
    b = T(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") + 100000).alias("b"))
    return T(s, d, "events").join(c, "user_id", "left").join(b, "user_id", "left").select("event_id", F.coalesce("a", "b").alias("agent"))


@query("msc_14_table_report", "SELECT 'memory' AS name, count(*) AS n, max(id) AS last FROM memory UNION ALL SELECT 'chunks', count(*), max(id) FROM chunks UNION ALL SELECT 'people', count(*), max(id) FROM people")
def _(s, d):
    out = None
    for t in ("memory", "chunks", "people"):
        part = T(s, d, t).agg(F.count("*").alias("n"), F.max("id").alias("last")).select(F.lit(t).alias("name"), "n", "last")
        out = part if out is None else out.unionByName(part)
    return out


@query("msc_15_heal", "SELECT r.id, CASE WHEN c.n IS NULL THEN 'drop' WHEN r.last_indexed IS NULL THEN 'index' WHEN r.description IS NULL THEN 'describe' ELSE 'keep' END AS action FROM repos r LEFT JOIN (SELECT repo_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.repo_id = r.id")
def _(s, d):
    c = T(s, d, "chunks").groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("n"))
    r = T(s, d, "repos").join(c, "id", "left")
    return r.select("id", F.when(F.col("n").isNull(), "drop").when(F.col("last_indexed").isNull(), "index").when(F.col("description").isNull(), "describe").otherwise("keep").alias("action"))


@query("msc_18_usage_name", "SELECT event_id, CASE WHEN event_type = 'error' THEN event_type || ':failed' ELSE event_type END AS command FROM events")
def _(s, d):
    return T(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.concat("event_type", F.lit(":failed"))).otherwise(F.col("event_type")).alias("command"))


@query("dml_12_repo_upsert", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN name || '-2' END, name) AS name, description FROM repos UNION ALL SELECT -id, name, NULL FROM repos WHERE id <> 0")
def _(s, d):
    """All repos are the existing side, and each of them gives a new row as well."""
    r = T(s, d, "repos").select("id", "name", "description")
    new = r.where("id % 2 = 0").select("id", F.concat("name", F.lit("-2")).alias("name"), F.lit(None).cast("string").alias("description"))
    fresh = r.where("id <> 0").select((-F.col("id")).alias("id"), "name", F.lit(None).cast("string").alias("description"))
    return C.patched(r, new, "id", ["name", "description"]).unionByName(fresh)


@query("msc_02_sources_in_order", "SELECT kind, doc_id, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS position FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'chunk', id, row_number() OVER (ORDER BY id) FROM chunks WHERE chunk_text IS NOT NULL UNION ALL SELECT 'transcript', id, row_number() OVER (ORDER BY id) FROM meetings WHERE transcript IS NOT NULL")
def _(s, d):
    """Every kind of item with a text, each in order of its id."""
    parts = [
        T(s, d, "documents").where("text IS NOT NULL").select("kind", "doc_id"),
        T(s, d, "chunks").where("chunk_text IS NOT NULL").select(F.lit("chunk").alias("kind"), F.col("id").alias("doc_id")),
        T(s, d, "meetings").where("transcript IS NOT NULL").select(F.lit("transcript").alias("kind"), F.col("id").alias("doc_id")),
    ]
    return O.numbered(parts[0].unionByName(parts[1]).unionByName(parts[2]), "doc_id", by="kind", name="position")


@query("win_03_cosine_rank", f"WITH {_SIM} SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM s WHERE score >= 0.05")
def _(s, d):
    return O.numbered(_scored(s, d).where("score >= 0.05"), F.col("score").desc(), "vec_id").select("vec_id", "place")


@query("srt_04_bm25_order", _STRICT.replace("SELECT doc, round(score, 6) AS score FROM b", "SELECT doc, row_number() OVER (ORDER BY score, title, doc) AS place FROM b JOIN documents ON doc_id = doc"))
def _(s, d):
    docs = T(s, d, "documents")
    hit = FT.scan_bm25(docs, DOCS, [["retry"], ["queue"]]).join(docs.select(F.col("doc_id").alias("doc"), "title"), "doc")
    return O.numbered(hit, "score", F.col("title").asc_nulls_last(), "doc").select("doc", "place")


_RANKED = f"""
{_SIM}, k AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY vec_id) AS pos FROM s WHERE label = 3), h AS (SELECT s.vec_id AS doc, 0 AS tier, k.pos AS input_pos, CASE WHEN s.vec_id % 2 = 0 THEN s.score END AS score FROM s JOIN k ON k.doc = s.vec_id
 UNION ALL (SELECT vec_id, 1, 1000000000 + row_number() OVER (ORDER BY score DESC, vec_id), score FROM s WHERE label <> 3 ORDER BY score DESC, vec_id LIMIT 25)),
r AS (SELECT *, CASE WHEN tier = 0 THEN 1 / (60 + row_number() OVER (PARTITION BY tier ORDER BY input_pos)) ELSE 0 END + CASE WHEN score IS NULL THEN 0 ELSE 1 / (60 + row_number() OVER (ORDER BY score DESC NULLS LAST, input_pos)) END AS rrf FROM h)"""


@query("evl_01_rankers", f"""
WITH {_RANKED} SELECT 'current' AS ranker, doc, row_number() OVER (ORDER BY round(rrf, 12) DESC, input_pos) AS place FROM r
UNION ALL SELECT 'keyword', doc, input_pos FROM r WHERE tier = 0
UNION ALL SELECT 'cosine', doc, row_number() OVER (ORDER BY score DESC, input_pos) FROM r WHERE score IS NOT NULL
UNION ALL SELECT 'cosine-order', doc, row_number() OVER (ORDER BY score DESC NULLS LAST, input_pos) FROM r""")
def _(s, d):
    """The four rankers of an evaluation over the hits of one search: keyword hits (every other one with a vector) and the
    nearest other records."""
    scored = _scored(s, d).select(F.col("vec_id").cast("bigint").alias("doc"), "label", "score")
    kw = O.numbered(scored.where("label = 3"), "doc", name="input_pos").select("doc", F.lit(0).alias("tier"), "input_pos", F.when(F.col("doc") % 2 == 0, F.col("score")).alias("score"))
    near = scored.where("label <> 3").orderBy(F.col("score").desc(), "doc").limit(25)
    near = O.numbered(near, F.col("score").desc(), "doc", name="p", rows=25).select("doc", F.lit(1).alias("tier"), (F.col("p") + 1_000_000_000).alias("input_pos"), "score")
    hits = kw.unionByName(near).withColumns({"type": F.lit("vector"), "tier_place": F.col("input_pos")})
    return E.ranked(hits, E.rankers(F.lit(False))).select("ranker", "doc", F.col("place").cast("bigint").alias("place"))


@query("vec_06_without_overlaps", GREEDY.format(f"SELECT id, repo_id, file_path, least(start_line, end_line) AS a, greatest(start_line, end_line) AS b, score FROM (SELECT *, len(list_filter(['store', 'retry', 'lock', 'return'], lambda q: list_contains({tok('chunk_text')}, q))) / 4 AS score FROM chunks WHERE chunk_text IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL) WHERE score > 0") + "SELECT c.id, c.repo_id, c.file_path, c.start_line, c.end_line, o.score FROM f JOIN chunks c USING (id) JOIN o USING (id)")
def _(s, d):
    """Chunks best first, none that overlaps a better one of its file (score: share of query terms)."""
    w = F.array_distinct(X.simple_tokens("chunk_text"))
    q = F.array(*[F.lit(t) for t in ("store", "retry", "lock", "return")])
    c = T(s, d, "chunks").where("chunk_text IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    scored = c.select("id", "repo_id", "file_path", "start_line", "end_line", X.overlap_ratio(q, w).alias("score"))
    return V.without_overlaps(scored.where("score > 0"), ["repo_id", "file_path"], "start_line", "end_line", "id")
