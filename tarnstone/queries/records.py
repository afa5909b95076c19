"""Histories, evaluation files, probes and the lives of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.functions import text as X
from tarnstone.operators import changes as C
from tarnstone.plans import embedding as EM
from tarnstone.plans import vectors as V
from tarnstone.sources import readers as S
from tarnstone.storage import table as T

# -- histories --------------------------------------------------------------------------------------------------------


def _log(s, d):
    """A dump of each repository's history, newest first: a line for the commit, then one for each path it changed."""
    c = T(s, d, "chunks").where("last_modified IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL").select("repo_id", "last_modified", "file_path").distinct()
    commits = c.groupBy("repo_id", "last_modified").agg(F.sort_array(F.collect_list("file_path")).alias("paths"))
    head = F.concat(F.lit("commit "), F.md5(F.concat_ws("/", "repo_id", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"))), F.lit(" "), F.unix_micros(F.col("last_modified").cast("timestamp")).cast("string"))
    return commits.select("repo_id", (-F.unix_micros(F.col("last_modified").cast("timestamp"))).alias("age"), F.posexplode(F.concat(F.array(head), "paths")).alias("n", "line"))


@query("src_08_newest_commit", "SELECT repo_id, file_path, max(last_modified) AS last_modified FROM chunks WHERE last_modified IS NOT NULL AND (repo_id, file_path) IN (SELECT (repo_id, file_path) FROM chunks WHERE repo_id IS NOT NULL AND file_path IS NOT NULL AND id % 2 = 0) GROUP BY 1, 2")
def _(s, d):
    """When each wanted path was last changed, read from the dumped histories. Wanted are the paths of every other chunk, so
    that paths nobody asked for are passed over."""
    wanted = T(s, d, "chunks").where("repo_id IS NOT NULL AND file_path IS NOT NULL AND id % 2 = 0").select("repo_id", "file_path").distinct()
    found = S.commit_dates(_log(s, d), ["repo_id"], ["age", "n"]).withColumnRenamed("path", "file_path").join(wanted, ["repo_id", "file_path"], "left_semi")
    return found.select("repo_id", "file_path", F.timestamp_micros("at").cast("timestamp_ntz").alias("last_modified"))


@query("src_19_identity", "SELECT repo_id, min_by(md5(repo_id || '/' || strftime(last_modified, '%Y-%m-%d %H:%M:%S')), (last_modified, md5(repo_id || '/' || strftime(last_modified, '%Y-%m-%d %H:%M:%S')))) AS root FROM chunks WHERE last_modified IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL GROUP BY repo_id")
def _(s, d):
    """A repository is known by its oldest commit; of commits of one moment the smaller hash counts."""
    return S.oldest_commit(_log(s, d), ["repo_id"], ["age", "n"]).select("repo_id", F.col("hash").alias("root"))


@query("src_09_changed_paths", """
WITH a AS (SELECT DISTINCT file_path FROM chunks WHERE repo_id <> 6 AND file_path IS NOT NULL), b AS (SELECT DISTINCT file_path FROM chunks WHERE repo_id <> 7 AND file_path IS NOT NULL)
SELECT file_path AS path, 'A' AS change FROM b WHERE file_path NOT IN (SELECT file_path FROM a) AND length(file_path) % 5 <> 0 UNION ALL SELECT file_path, 'D' FROM a WHERE file_path NOT IN (SELECT file_path FROM b) AND length(file_path) % 5 <> 0
UNION ALL SELECT 'moved/' || file_path, 'A' FROM a WHERE file_path NOT IN (SELECT file_path FROM b) AND length(file_path) % 5 = 0 UNION ALL SELECT file_path, 'D' FROM a WHERE file_path NOT IN (SELECT file_path FROM b) AND length(file_path) % 5 = 0
UNION ALL SELECT file_path, 'A' FROM b WHERE file_path NOT IN (SELECT file_path FROM a) AND length(file_path) % 5 = 0""")
def _(s, d):
    """Paths changed between two revisions, from a listing of states: added, deleted, and renamed ones (which are both)."""
    c = T(s, d, "chunks").where("file_path IS NOT NULL")
    a, b = [c.where(f"repo_id <> {r}").select("file_path").distinct() for r in (6, 7)]
    gone, new = a.join(b, "file_path", "left_anti"), b.join(a, "file_path", "left_anti")
    moved = F.length("file_path") % 5 == 0
    line = gone.select(F.when(moved, F.concat(F.lit("R087\t"), "file_path", F.lit("\tmoved/"), "file_path")).otherwise(F.concat(F.lit("D\t"), "file_path")).alias("line"))
    return S.name_status(line.unionByName(new.select(F.concat(F.lit("A\t"), "file_path").alias("line"))), "line")


@query("src_15_eval_queries", "SELECT item_id, kind, text AS query, [item_id * 10, item_id * 10 + 1] AS relevant FROM eval_items WHERE trim(text) <> ''")
def _(s, d):
    """Evaluation queries written as TOML, one file an item, read back with every field checked."""
    quote = F.concat(F.lit("'''"), F.col("text"), F.lit("'''"))
    item = F.col("item_id").cast("string")
    file = F.concat(F.lit("[[query]]\nid = "), item, F.lit("\nkind = '"), F.col("kind"), F.lit("'\ntext = "), quote, F.lit("\nrelevant = ["), (F.col("item_id") * 10).cast("string"), F.lit(", "), (F.col("item_id") * 10 + 1).cast("string"), F.lit("]\n"))
    return S.eval_queries(T(s, d, "eval_items").where("trim(text) <> ''").select(file.alias("file")), "file").select(F.col("id").alias("item_id"), "kind", F.col("text").alias("query"), "relevant")


# -- probes -----------------------------------------------------------------------------------------------------------

_LETTERS = "list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda c: CAST(length({0}) - length(replace({0}, c, '')) AS DOUBLE))"


@query("vec_10_probe_windows", f"""
WITH c AS (SELECT id AS chunk, chunk_text AS x, greatest(length(chunk_text) - 200, 0) AS span FROM chunks WHERE id % 100 = 0 AND trim(chunk_text) <> ''),
w AS (SELECT DISTINCT chunk, substring(x, CAST(floor(span * i / 7) AS INT) + 1, 200) AS win, floor(span * i / 7) AS at FROM c, (SELECT unnest(range(0, 8)) AS i)),
p AS (SELECT chunk, {_LETTERS.format('win')} AS v FROM w), m AS (SELECT key, {_LETTERS.format('value')} AS v FROM memory WHERE status = 'active' AND trim(value) <> '' AND key IS NOT NULL),
s AS (SELECT chunk, key, max(list_cosine_similarity(p.v, m.v)) AS score FROM p, m WHERE list_sum(p.v) > 0 AND list_sum(m.v) > 0 GROUP BY 1, 2)
SELECT chunk, round(score, 4) AS score, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY score DESC) AS p FROM s) WHERE p <= 5 GROUP BY 1, 2""")
def _(s, d):
    """Memories related to a chunk: eight windows of it are asked for, and a key counts by its best score in any."""
    model = EM.Embedder(EM.letters)
    c = T(s, d, "chunks").where("id % 100 = 0 AND trim(chunk_text) <> ''").select("id", F.explode(X.probe_windows("chunk_text", 200, 8)).alias("window"))
    probes = EM.embedded(c, "id", "window", model)
    m = T(s, d, "memory").where("status = 'active' AND key IS NOT NULL")
    rows = EM.embedded(m, "key", "value", model)
    best = V.best_keys(rows, probes, "key", "id", "vec", 5)
    return best.groupBy(F.col("id").alias("chunk"), F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))


# -- lives ------------------------------------------------------------------------------------------------------------


@query("dml_10_transitions", """
WITH i AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'concluded' ELSE 'abandoned' END AS was, CASE doc_id % 4 WHEN 0 THEN 'conclude' WHEN 1 THEN 'reopen' WHEN 2 THEN 'abandon' ELSE 'start' END AS verb FROM documents WHERE kind = 'investigation')
SELECT doc_id, CASE WHEN verb IN ('conclude', 'abandon') AND was = 'open' THEN verb || CASE verb WHEN 'conclude' THEN 'd' ELSE 'ed' END WHEN verb = 'reopen' AND was <> 'open' THEN 'open' ELSE was END AS status,
 (verb IN ('conclude', 'abandon') AND was = 'open') OR (verb = 'reopen' AND was <> 'open') AS moved FROM i""")
def _(s, d):
    """Investigations under the verbs of their life: what a state doesn't allow changes nothing, and says so."""
    i = T(s, d, "documents").where("kind = 'investigation'").select("doc_id", F.element_at(F.array(*map(F.lit, ("open", "concluded", "abandoned"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"), F.element_at(F.array(*map(F.lit, ("conclude", "reopen", "abandon", "start"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("verb"))
    allowed = {("open", "conclude"): "concluded", ("open", "abandon"): "abandoned", ("concluded", "reopen"): "open", ("abandoned", "reopen"): "open"}
    return C.transitions(i, "status", "verb", allowed).select("doc_id", "status", "moved")


@query("dml_15_file_upsert", """
WITH o AS (SELECT repo_id, file_path, max(md5(chunk_text)) AS hash, max(last_modified) AS last_modified FROM chunks WHERE repo_id IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2),
n AS (SELECT repo_id, file_path, CASE WHEN length(file_path) % 3 = 0 THEN 'new' || hash ELSE hash END AS hash FROM o WHERE repo_id <> 5 UNION ALL SELECT repo_id, 'added/' || file_path, hash FROM o WHERE repo_id = 4)
SELECT n.repo_id, n.file_path, n.hash, CASE WHEN o.hash = n.hash THEN o.last_modified END AS last_modified FROM n LEFT JOIN o ON o.repo_id = n.repo_id AND o.file_path = n.file_path""")
def _(s, d):
    """Files brought up to date with a walk: another hash clears the date, a file that is gone goes, a new one has none."""
    c = T(s, d, "chunks").where("repo_id IS NOT NULL AND file_path IS NOT NULL")
    known = c.groupBy("repo_id", "file_path").agg(F.max(F.md5(F.col("chunk_text").cast("binary"))).alias("hash"), F.max("last_modified").alias("last_modified"))
    same = known.where("repo_id <> 5").select("repo_id", "file_path", F.when(F.length("file_path") % 3 == 0, F.concat(F.lit("new"), "hash")).otherwise(F.col("hash")).alias("hash"))
    walk = same.unionByName(known.where("repo_id = 4").select("repo_id", F.concat(F.lit("added/"), "file_path").alias("file_path"), "hash"))
    return C.files_after(known, walk, ["repo_id", "file_path"], "hash", ["last_modified"])


@query("dml_17_take_over", """
WITH a AS (SELECT user_id AS agent, 'n' || (user_id // 10) AS name, max(ts) AS seen FROM events GROUP BY 1, 2), w AS (SELECT name, arg_max(agent, (seen, agent)) AS holder FROM a GROUP BY name)
SELECT e.event_id, w.holder AS mailbox FROM events e JOIN a ON a.agent = e.user_id JOIN w ON w.name = a.name""")
def _(s, d):
    """Agents that registered under one name: the last one holds it, and the mail of all is in its box."""
    e = T(s, d, "events")
    agents = e.groupBy(F.col("user_id").alias("agent")).agg(F.max("ts").alias("seen")).withColumn("name", F.concat(F.lit("n"), F.floor(F.col("agent") / 10).cast("string")))
    return C.taken_over(e.select("event_id", F.col("user_id").alias("agent")), agents).select("event_id", "mailbox")


@query("dml_23_identifiers", """
WITH g AS (SELECT id, 'email' AS type, email AS value FROM people WHERE trim(email) <> '' UNION ALL SELECT id, 'github', github_username FROM people WHERE trim(github_username) <> '' UNION ALL SELECT id, 'fax', slack_id FROM people WHERE slack_id <> '')
SELECT id, type, value, CASE WHEN type = 'fax' THEN 'unknown type' WHEN count(*) OVER (PARTITION BY type, value) > 1 AND id > min(id) OVER (PARTITION BY type, value) THEN 'taken' ELSE 'ok' END AS state FROM g""")
def _(s, d):
    """Identifiers given to people: of a type that isn't registered they are refused, as are values somebody has."""
    p = T(s, d, "people")
    part = lambda t, c: p.where(F.trim(F.col(c)) != "").select("id", F.lit(t).alias("type"), F.col(c).alias("value"))
    given = part("email", "email").unionByName(part("github", "github_username")).unionByName(p.where("slack_id <> ''").select("id", F.lit("fax").alias("type"), F.col("slack_id").alias("value")))
    return C.identifiers(given, ["email", "github", "slack"], "id")
