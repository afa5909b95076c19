"""Stores, sources, joins on search results, and the functions and plug-ins that a session can register."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnstone import storage
from tarnstone.catalog import query
from tarnstone.functions import dates as D
from tarnstone.functions import maths as M
from tarnstone.functions import text as X
from tarnstone.functions import wordpiece
from tarnstone.operators import changes as C
from tarnstone.operators import ordering as O
from tarnstone.plans import embedding as EM
from tarnstone.plans import evaluation as E
from tarnstone.plans import fulltext as FT
from tarnstone.plans import fusion as FU
from tarnstone.plans import reports as R
from tarnstone.plans import vectors as V
from tarnstone.queries.scalars import low
from tarnstone.queries.search import DOCS, MEETINGS, MEMORY, bm25_sql
from tarnstone.sources import readers as S
from tarnstone.storage import table as T
from tarnstone.streaming import incremental as I

TABLES = ("chunks", "documents", "meetings", "memory", "people", "repos")


def good_sql(c: str) -> str:
    return f"len({c}) = 384 AND isfinite(list_sum({c})) AND list_sum(list_transform({c}, lambda x: abs(x))) > 0"


def good(rows, c: str):
    """Rows with a usable vector: 384 finite numbers, not all zero."""
    most, least = F.array_max(c), F.array_min(c)  # a NaN is the greatest number
    return rows.where((F.size(c) == 384) & (most < float("inf")) & (least > float("-inf")) & ((most > 0) | (least < 0)))


# -- stores and sources -----------------------------------------------------------------------------------------------


@query("src_01_open_store", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def _(s, d):
    store = storage.open_store(s, d, "store_")
    out = None
    for t in TABLES:
        part = s.sql(f"SELECT '{t}' AS name, count(*) AS n FROM store_{t}") if t in store else s.createDataFrame([(t, 0)], "name string, n long")
        out = part if out is None else out.unionByName(part)
    return out


@query("src_02_repo_store", "SELECT file_path, count(*) AS chunks, max(end_line) AS last_line FROM chunks WHERE repo_id = 1 GROUP BY file_path")
def _(s, d):
    return storage.repo_store(T(s, d, "chunks"), 1).groupBy("file_path").agg(F.count("*").alias("chunks"), F.max("end_line").alias("last_line"))


@query("src_14_text_bodies", "SELECT id, description AS body FROM repos WHERE description <> ''")
def _(s, d):
    """Bodies handed over as files, one record a file, read whole with the record's id in the path."""
    out = storage.folder(s, "bodies")
    T(s, d, "repos").where("description <> ''").select("id", F.col("description").alias("value")).repartition("id").write.mode("overwrite").partitionBy("id").text(out)
    return S.text_bodies(s, out, "id").select(F.col("id").cast("bigint").alias("id"), "body")


_LETTERS = "list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda c: CAST(length({0}) - length(replace({0}, c, '')) AS DOUBLE))"


@query("src_17_embedder", f"SELECT id, list_transform(n, lambda x: round(CAST(CAST(x / sqrt(list_dot_product(n, n)) AS FLOAT) AS DOUBLE), 5)) AS vec FROM (SELECT id, {_LETTERS.format(chr(39) + 'passage: ' + chr(39) + ' || value')} AS n FROM memory WHERE trim(value, ' ') <> '')")
def _(s, d):
    v = EM.embedded(T(s, d, "memory"), "id", "value", EM.Embedder(EM.letters, "passage: ", "query: "))
    return v.select("id", F.transform("vec", lambda x: F.round(x.cast("double"), 5)).alias("vec"))


@query("src_18_probe", "SELECT t.name, t.name IN (SELECT table_name FROM information_schema.tables) AS present FROM (SELECT unnest(['memory', 'jobs', 'chunks', 'outbox']) AS name) t")
def _(s, d):
    return s.createDataFrame(sorted(storage.probe(s, d, ["memory", "jobs", "chunks", "outbox"]).items()), "name string, present boolean")


@query("src_20_settings", """
SELECT id, greatest(200, least(4000, coalesce(CASE WHEN id % 5 = 0 THEN 9000 END, CASE WHEN id % 3 = 0 THEN 100 END, 40 * length(path), 800))) AS chunk,
 least(greatest(200, least(4000, coalesce(CASE WHEN id % 5 = 0 THEN 9000 END, CASE WHEN id % 3 = 0 THEN 100 END, 40 * length(path), 800))) // 2, coalesce(50 * length(name), 200)) AS overlap FROM repos""")
def _(s, d):
    r = T(s, d, "repos")
    layers = [F.when(F.col("id") % 5 == 0, F.lit(9000)), F.when(F.col("id") % 3 == 0, F.lit(100)), 40 * F.length("path")]
    chunk = S.setting(layers, 800, 200, 4000)
    return r.select("id", chunk.cast("bigint").alias("chunk"), F.least(F.floor(chunk / 2), F.coalesce(50 * F.length("name"), F.lit(200))).cast("bigint").alias("overlap"))


_PARTS = r"""
pt AS (SELECT id AS message, n, line FROM (SELECT id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT id, string_split(regexp_replace(transcript, '\r', '', 'g'), chr(10)) AS x FROM meetings WHERE starts_with(ltrim(transcript), '{'))) WHERE json_valid(line) AND starts_with(ltrim(line), '{'))"""


def _parts(s, d):
    """Messages and their JSON parts, as an agent's own store has them: one part a line."""
    m = T(s, d, "meetings").where(F.startswith(F.ltrim("transcript"), F.lit("{")))
    lines = F.split(F.regexp_replace("transcript", "\r", ""), "\n")
    return m.select(F.col("id").alias("message"), F.posexplode(lines).alias("at", "line")).where(F.startswith(F.ltrim("line"), F.lit("{")) & F.get_json_object("line", "$").isNotNull()).select("message", (F.col("at") + 1).alias("n"), "line")


@query("src_13_session_store", f"""
WITH {_PARTS} SELECT message, n, row_number() OVER (PARTITION BY message ORDER BY CAST(json_extract_string(line, '$.start') AS DOUBLE) NULLS FIRST, n) AS position, json_extract_string(line, '$.text') AS text FROM pt""")
def _(s, d):
    w = W.partitionBy("message").orderBy(F.get_json_object("line", "$.start").cast("double"), "n")
    return _parts(s, d).select("message", F.col("n").cast("bigint").alias("n"), F.row_number().over(w).cast("bigint").alias("position"), F.get_json_object("line", "$.text").alias("text"))


@query("jon_26_message_parts", f"WITH {_PARTS} SELECT m.id, m.title, count(*) AS parts, count(json_extract_string(line, '$.speaker')) AS spoken FROM meetings m JOIN pt ON pt.message = m.id GROUP BY 1, 2")
def _(s, d):
    p = _parts(s, d).withColumn("speaker", F.get_json_object("line", "$.speaker"))
    return T(s, d, "meetings").select(F.col("id").alias("message"), "title").join(p, "message").groupBy(F.col("message").alias("id"), "title").agg(F.count("*").alias("parts"), F.count("speaker").alias("spoken"))


@query("snk_09_run_history", """
WITH r AS (SELECT user_id, ts, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events WHERE event_type IN ('signup', 'error'))
SELECT user_id, count(*) FILTER (event_type = 'signup') AS starts, count(*) FILTER (event_type = 'signup' AND next = 'signup') AS crashed FROM r WHERE age <= 20 GROUP BY user_id""")
def _(s, d):
    """The last twenty entries of each history; a start that another start follows had no end: it crashed."""
    e = T(s, d, "events").where("event_type IN ('signup', 'error')")
    return I.run_history(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", 20).groupBy("user_id").agg(F.count_if("started").alias("starts"), F.count_if("crashed").alias("crashed"))


# -- joins on search results ------------------------------------------------------------------------------------------

_INDEX = bm25_sql("memory", "id", MEMORY.weights, ["index"], True)


@query("jon_01_hits_records", f"WITH {_INDEX} SELECT m.id, m.key, m.status, round(score, 6) AS score FROM b JOIN memory m ON m.id = b.doc")
def _(s, d):
    m = T(s, d, "memory")
    return FT.scan_bm25(m, MEMORY, [["index"]]).withColumnRenamed("doc", "id").join(m.select("id", "key", "status"), "id").select("id", "key", "status", F.round("score", 6).alias("score"))


_KNN = f"k AS (SELECT id, list_cosine_similarity(vec::DOUBLE[], (SELECT vec FROM reembed_staging WHERE tbl = {{0}} AND {good_sql('vec')} ORDER BY id LIMIT 1)::DOUBLE[]) AS score FROM reembed_staging WHERE tbl = {{0}} AND {good_sql('vec')})"


def _staged(s, d, tbl: int):
    v = good(T(s, d, "reembed_staging").where(F.col("tbl") == tbl), "vec")
    return V.similar_to(v.select("id", "vec"), v.orderBy("id").limit(1), "vec")


@query("jon_08_knn_parent", f"WITH {_KNN.format(1)}, t AS (SELECT * FROM k ORDER BY score DESC, id LIMIT 40) SELECT r.name, c.file_path, t.id, round(t.score, 6) AS score FROM t JOIN chunks c ON c.id = t.id JOIN repos r ON r.id = c.repo_id")
def _(s, d):
    top = V.top_k(_staged(s, d, 1), 40, "id")
    c = T(s, d, "chunks").select("id", "repo_id", "file_path").join(T(s, d, "repos").select(F.col("id").alias("repo_id"), "name"), "repo_id")
    return top.join(c, "id").select("name", "file_path", "id", F.round("score", 6).alias("score"))


@query("jon_10_pair_vectors", f"""
WITH v AS (SELECT id, embedding FROM memory WHERE {good_sql('embedding')})
SELECT c.id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM memory_conflicts c JOIN v a ON a.id = c.memory_id JOIN v b ON b.id = c.matched_id""")
def _(s, d):
    v = good(T(s, d, "memory"), "embedding").select("id", "embedding")
    a, b = v.select(F.col("id").alias("memory_id"), F.col("embedding").alias("x")), v.select(F.col("id").alias("matched_id"), F.col("embedding").alias("y"))
    return T(s, d, "memory_conflicts").join(a, "memory_id").join(b, "matched_id").select("id", F.round(M.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("jon_12_candidates", f"WITH {_INDEX} SELECT id, key FROM memory WHERE status = 'active' AND id IN (SELECT doc FROM b)")
def _(s, d):
    m = T(s, d, "memory")
    hits = FT.scan_bm25(m, MEMORY, [["index"]]).select(F.col("doc").alias("id"))
    return m.where("status = 'active'").join(hits, "id", "left_semi").select("id", "key")


@query("jon_21_guarded_insert", "SELECT c.id, a.id AS recipient, CASE WHEN a.id IS NULL THEN 'refused' ELSE 'sent' END AS state FROM memory_conflicts c LEFT JOIN memory a ON a.id = c.matched_id AND coalesce(a.status, '') <> 'superseded'")
def _(s, d):
    """A message is inserted if its recipient is there and hasn't left; else it is refused, with its row."""
    mail = T(s, d, "memory_conflicts").select("id", F.col("matched_id").alias("to"))
    agents = T(s, d, "memory").select(F.col("id").alias("agent"), (F.coalesce("status", F.lit("")) == "superseded").alias("left"))
    return C.addressed(mail, agents, "to").select("id", "recipient", "state")


@query("jon_24_exact_knn", f"WITH {_KNN.format(0)} SELECT id, round(score, 6) AS score FROM k ORDER BY k.score DESC, id LIMIT 30")
def _(s, d):
    return V.top_k(_staged(s, d, 0), 30, "id").select("id", F.round("score", 6).alias("score"))


_FILES = f"""
f AS (SELECT repo_id, file_path, max(last_modified) AS changed, bool_or(contains(lower(chunk_text), 'retry queue')) AS phrase, bool_or(contains(lower(chunk_text), 'retry')) AND bool_or(contains(lower(chunk_text), 'queue')) AS hit FROM chunks GROUP BY 1, 2)"""


@query("jon_27_files_by_date", f"WITH {_FILES} SELECT repo_id, file_path, phrase FROM f WHERE hit AND changed >= TIMESTAMP '2025-06-01' ORDER BY phrase DESC, repo_id, file_path LIMIT 200")
def _(s, d):
    has = lambda t: F.coalesce(F.bool_or(F.contains(F.lower("chunk_text"), F.lit(t))), F.lit(False))
    f = T(s, d, "chunks").groupBy("repo_id", "file_path").agg(F.max("last_modified").alias("changed"), has("retry queue").alias("phrase"), (has("retry") & has("queue")).alias("hit"))
    f = f.where(F.col("hit") & (F.col("changed") >= F.lit("2025-06-01").cast("timestamp_ntz")))
    return f.orderBy(F.col("phrase").desc(), "repo_id", "file_path").limit(200).select("repo_id", "file_path", "phrase")


@query("fts_10_substring_files", f"WITH {_FILES} SELECT repo_id, file_path FROM f WHERE hit")
def _(s, d):
    """Files that hold every term of three or more characters, as a trigram index would find them."""
    terms = X.trigram_terms("retry queue or")
    has = lambda t: F.bool_or(F.contains(F.lower("chunk_text"), F.lit(t)))
    f = T(s, d, "chunks").groupBy("repo_id", "file_path").agg(*[has(t).alias(f"h{k}") for k, t in enumerate(t for t in terms if len(t) >= 3)])
    return f.where("h0 AND h1").select("repo_id", "file_path")


@query("agg_15_statistics", f"WITH {bm25_sql('documents', 'doc_id', DOCS.weights, ['retry', 'queue'], True)} SELECT df.ph AS phrase, st.n, round(st.mean, 6) AS mean, df.df FROM df, st")
def _(s, d):
    return FT.statistics(T(s, d, "documents"), DOCS, [["retry"], ["queue"]]).select("phrase", "n", F.round("mean", 6).alias("mean"), "df")


_SCORED = f"""
h AS (SELECT doc, row_number() OVER (ORDER BY doc) AS input_pos FROM (SELECT id AS doc FROM memory WHERE contains({low('value')}, 'retry queue') ORDER BY id LIMIT 60)),
q AS (SELECT h.doc, h.input_pos, CASE WHEN {good_sql('m.embedding')} THEN list_cosine_similarity(m.embedding::DOUBLE[], (SELECT embedding FROM memory WHERE {good_sql('embedding')} ORDER BY id LIMIT 1)::DOUBLE[]) END AS score, m.key FROM h JOIN memory m ON m.id = h.doc)"""


def _hits(s, d):
    m = T(s, d, "memory")
    hit = FT.substring_hits(m, FT.Source("id", {"value": 1.0}), "retry queue").orderBy("doc").limit(60).withColumn("g", F.lit(0))
    hit = O.first_per(hit, ["g"], F.col("doc"), n=60, rank="input_pos")
    g = good(m, "embedding")
    scores = V.similar_to(g.select(F.col("id").alias("doc"), "embedding"), g.orderBy("id").limit(1), "embedding")
    return hit.join(scores, "doc", "left").join(m.select(F.col("id").alias("doc"), "key"), "doc").select("doc", "input_pos", "score", "key")


@query("srt_07_cosine_order", f"WITH {_SCORED} SELECT doc, row_number() OVER (ORDER BY score DESC NULLS LAST, input_pos) AS place FROM q")
def _(s, d):
    return FU.by_cosine(_hits(s, d)).select("doc", F.col("place").cast("bigint").alias("place"))


@query("srt_08_fusion_order", f"""
WITH {_SCORED}, r AS (SELECT *, 1 / (60 + row_number() OVER (ORDER BY input_pos)) + CASE WHEN score IS NULL THEN 0 ELSE 1 / (60 + row_number() OVER (ORDER BY score DESC NULLS LAST, input_pos)) END AS rrf, lower(trim(key)) = (SELECT lower(trim(key)) FROM q ORDER BY doc DESC LIMIT 1) AS named FROM q)
SELECT doc, row_number() OVER (ORDER BY named DESC, rrf DESC, input_pos) AS place FROM r""")
def _(s, d):
    hits = _hits(s, d).withColumns({"type": F.lit("memory"), "tier": F.lit(0), "tier_place": F.col("input_pos")})
    last = hits.orderBy(F.col("doc").desc()).limit(1).select("key").first()
    return FU.fused(hits, X.names_query("key", last[0] if last else "")).select("doc", F.col("place").cast("bigint").alias("place"))


@query("fus_03_order", f"WITH {_SCORED} SELECT doc, 'cosine' AS ranking, row_number() OVER (ORDER BY score DESC NULLS LAST, input_pos) AS place FROM q UNION ALL SELECT doc, 'given', input_pos FROM q")
def _(s, d):
    hits = _hits(s, d).withColumns({"type": F.lit("memory"), "tier": F.lit(0), "tier_place": F.col("input_pos")})
    out = [FU.ordered(hits, r, F.lit(False)).select("doc", F.lit(r).alias("ranking"), F.col("place").cast("bigint").alias("place")) for r in ("cosine", "given")]
    return out[0].unionByName(out[1])


@query("srt_13_loose_tail", f"""
WITH {bm25_sql('meetings', 'id', MEETINGS.weights, ['retro'], True)}, seen AS (SELECT doc FROM b), lo AS (WITH {bm25_sql('meetings', 'id', MEETINGS.weights, ['retro', 'staging', 'incident'], False)} SELECT doc, score FROM b)
SELECT doc, round(score, 6) AS score FROM (SELECT doc, score FROM lo WHERE doc NOT IN (SELECT doc FROM seen) ORDER BY score, doc LIMIT 10)""")
def _(s, d):
    m = T(s, d, "meetings")
    seen = FT.scan_bm25(m, MEETINGS, [["retro"]]).select("doc")
    loose = FT.scan_bm25(m, MEETINGS, [["retro"], ["staging"], ["incident"]], every=False)
    return FT.loose_tail(seen, loose, X.LOOSE_LIMIT).select("doc", F.round("score", 6).alias("score"))


@query("srt_14_page", "SELECT id FROM memory WHERE id > (SELECT id FROM memory ORDER BY id OFFSET 63 LIMIT 1) ORDER BY id LIMIT 64")
def _(s, d):
    m = T(s, d, "memory").select("id")
    last = O.page_after(m, "id", None, 64).agg(F.max("id")).first()[0]
    return O.page_after(m, "id", last, 64)


@query("set_06_wanted_paths", "SELECT DISTINCT file_path FROM chunks WHERE last_modified IS NOT NULL AND file_path NOT IN (SELECT file_path FROM chunks WHERE last_modified IS NULL AND file_path IS NOT NULL)")
def _(s, d):
    c = T(s, d, "chunks")
    return c.where("last_modified IS NOT NULL").select("file_path").distinct().join(c.where("last_modified IS NULL").select("file_path"), "file_path", "left_anti")


# -- functions --------------------------------------------------------------------------------------------------------

_SPLIT = r"""
WITH RECURSIVE p AS (SELECT doc_id, unnest(x) AS para, generate_subscripts(x, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
r(doc_id, no, k, piece, rest) AS (
 SELECT doc_id, no, 0, CAST(NULL AS VARCHAR), para FROM p WHERE regexp_matches(para, '\S')
 UNION ALL
 SELECT doc_id, no, k + 1, CASE WHEN length(rest) <= 120 THEN rest ELSE regexp_replace(left(rest, cut), '\s+$', '') END, CASE WHEN length(rest) <= 120 THEN NULL ELSE regexp_replace(substring(rest, cut + 1), '^\s+', '') END
 FROM (SELECT *, CASE WHEN regexp_matches(left(rest, 120), '(?s)^.+[\n ]') THEN length(regexp_extract(left(rest, 120), '(?s)^.+[\n ]')) ELSE 120 END AS cut FROM r WHERE rest IS NOT NULL AND rest <> ''))
SELECT doc_id, CAST(no AS BIGINT) AS paragraph, piece FROM r WHERE k > 0 AND piece <> ''"""


@query("str_17_split_long", _SPLIT)
def _(s, d):
    """Paragraphs in pieces of at most 120 characters."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, n, x) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for n, p in enumerate(t.split("\n\n"), 1) if p.strip() for x in X.split_long(p, 120)]
            yield pd.DataFrame(rows, columns=["doc_id", "paragraph", "piece"])

    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, "doc_id long, paragraph long, piece string")


@query("str_18_overlap_tail", """
SELECT id, CASE WHEN length(value) <= least(200, room) THEN value WHEN least(200, length(value), room - 3) > 0 THEN '...' || right(value, CAST(least(200, length(value), room - 3) AS INT)) ELSE '' END AS tail
FROM (SELECT id, value, id % 300 AS room FROM memory WHERE value IS NOT NULL AND value <> '')""")
def _(s, d):
    m = T(s, d, "memory").where("value <> ''").select("id", "value", (F.col("id") % 300).cast("int").alias("room"))

    def run(batches):
        for pdf in batches:
            pdf["tail"] = [X.overlap_tail(v, 200, int(r)) for v, r in zip(pdf["value"], pdf["room"], strict=True)]
            yield pdf[["id", "tail"]]

    return m.mapInPandas(run, "id long, tail string")


@query("dat_04_ranges", """
SELECT id, CASE WHEN hi IS NULL THEN 'unreadable' WHEN date_trunc('second', created_at) > hi THEN 'reversed' ELSE 'ok' END AS state
FROM (SELECT id, created_at, CASE WHEN regexp_matches(trim(updated_at), '^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2})?(\\.\\d+)?Z?)?$') THEN date_trunc('second', TRY_CAST(regexp_replace(trim(updated_at), 'Z$', '') AS TIMESTAMP)) END AS hi FROM memory WHERE created_at IS NOT NULL)""")
def _(s, d):
    m = T(s, d, "memory").where("created_at IS NOT NULL")
    return m.select("id", D.range_state(F.date_trunc("second", "created_at").cast("timestamp_ntz"), D.read_stamp(F.col("updated_at"))).alias("state"))


@query("mth_02_distance", f"SELECT c.id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM memory_conflicts c JOIN (SELECT * FROM memory WHERE {good_sql('embedding')}) a ON a.id = least(c.memory_id, c.matched_id) JOIN (SELECT * FROM memory WHERE {good_sql('embedding')}) b ON b.id = greatest(c.memory_id, c.matched_id)")
def _(s, d):
    v = good(T(s, d, "memory"), "embedding").select("id", "embedding")
    c = T(s, d, "memory_conflicts").select("id", F.least("memory_id", "matched_id").alias("lo"), F.greatest("memory_id", "matched_id").alias("hi"))
    both = c.join(v.select(F.col("id").alias("lo"), F.col("embedding").alias("x")), "lo").join(v.select(F.col("id").alias("hi"), F.col("embedding").alias("y")), "hi")
    return both.select("id", F.round(M.cosine_distance(F.col("x"), F.col("y")), 6).alias("distance"))


@query("mth_04_weighted_bm25", f"WITH {bm25_sql('meetings', 'id', MEETINGS.weights, ['retro'], True)} SELECT doc, round(score, 6) AS score FROM b")
def _(s, d):
    m = T(s, d, "meetings")
    return FT.bm25(FT.postings(m, MEETINGS), m, [["retro"]], MEETINGS.weights).select("doc", F.round("score", 6).alias("score"))


@query("mth_07_count_tokens", r"""
SELECT doc_id, length(regexp_replace(title, '[^a-zA-Z0-9\-]', '', 'g')) AS exact, CAST(ceil(octet_length(encode(title)) / 4) AS BIGINT) AS estimate FROM documents WHERE regexp_matches(title, '^[a-zA-Z0-9 \-]*$')""")
def _(s, d):
    """Exact counts by a vocabulary (here one of single letters and digits), and the estimate without one."""
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    vocabulary = frozenset([*signs, *("##" + c for c in signs), "-"])

    def run(batches):
        for pdf in batches:
            pdf["exact"] = [wordpiece.count_tokens(t, vocabulary) for t in pdf["title"]]
            pdf["estimate"] = [wordpiece.count_tokens(t, None) for t in pdf["title"]]
            yield pdf[["doc_id", "exact", "estimate"]]

    return T(s, d, "documents").where(r"title RLIKE '^[a-zA-Z0-9 \\-]*$'").select("doc_id", "title").mapInPandas(run, "doc_id long, exact long, estimate long")


@query("arr_03_vector_bytes", "SELECT vec_id, 4 * len(embedding) AS bytes, TRUE AS same FROM embeddings WHERE embedding IS NOT NULL")
def _(s, d):
    e = T(s, d, "embeddings")
    raw = EM.packed_floats(e, "vec_id", "embedding")
    back = EM.unpacked_floats(raw, "vec_id", "raw")
    return e.join(raw, "vec_id").join(back, "vec_id").select("vec_id", F.octet_length("raw").cast("bigint").alias("bytes"), F.col("embedding").eqNullSafe(F.col("vec")).alias("same"))


@query("arr_06_replies", """
SELECT id, key, md5(value) AS value, CASE WHEN id % 2 = 0 THEN coalesce(memory_type, 'project') ELSE 'project' END AS type, CASE WHEN id % 3 = 0 THEN CAST(superseded_by AS VARCHAR) END AS supersedes, id % 4 = 0 AS repo_scope, id AS project
FROM memory WHERE key IS NOT NULL AND key <> '' AND value IS NOT NULL AND value <> ''""")
def _(s, d):
    m = T(s, d, "memory").where("key <> '' AND value <> ''")
    fact = F.struct(
        "key", "value", F.when(F.col("id") % 2 == 0, F.col("memory_type")).alias("type"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), F.col("superseded_by").cast("string"), F.lit(" "))).otherwise(F.lit("  ")).alias("supersedes"),
        F.when(F.col("id") % 4 == 0, F.lit(" REPO ")).alias("scope"), F.concat(F.lit("#"), F.col("id").cast("string")).alias("project"),
    )
    reply = m.select("id", F.concat(F.lit("Sure, here it is:\n```json\n"), F.to_json(F.array(fact)), F.lit("\n```")).alias("reply"))
    facts = S.reply_facts(reply, "id", "reply")
    return facts.select("id", "key", F.md5("value").alias("value"), "type", "supersedes", "repo_scope", "project")


@query("arr_07_message_content", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE coalesce(title, '') || chr(10) || text END) AS text FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """Content that is a string, or a list of blocks of which those of text count."""
    doc = T(s, d, "documents").where("text IS NOT NULL")
    block = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    blocks = F.to_json(F.array(block("text", F.coalesce("title", F.lit(""))), block("image", F.lit("no")), block("text", F.col("text"))))
    content = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("c")))).otherwise(F.concat(F.lit('{"c":'), blocks, F.lit("}")))
    return doc.select("doc_id", F.md5(S.content_text(F.get_json_object(content, "$.c"), F.col("doc_id") % 2 == 1, "\n")).alias("text"))


@query("vec_04_investigations", """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT d.doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]) AS score FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, q WHERE d.kind = 'investigation' AND d.created_at >= TIMESTAMP '2025-01-01')
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 25""")
def _(s, d):
    doc = T(s, d, "documents").where((F.col("kind") == "investigation") & (F.col("created_at") >= F.lit("2025-01-01").cast("timestamp_ntz"))).select("doc_id")
    e = T(s, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("doc_id"), "embedding").join(doc, "doc_id", "left_semi")
    return V.top_k(V.similar_to(rows, e.where("vec_id = 0"), "embedding"), 25, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


# -- schedules and mail -----------------------------------------------------------------------------------------------


@query("stm_12_two_lanes", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, ts, event_id) AS turn FROM events""")
def _(s, d):
    """What waits for a worker (here: of a user) in the order it gets its turn: queries first, bulk as it came."""
    return I.turns_of_lanes(T(s, d, "events"), ["user_id"], F.col("event_type") == "error", ["ts", "event_id"]).select("user_id", "event_id", F.col("turn").cast("bigint").alias("turn"))


@query("msc_11_mail_peek", """
SELECT m.id, EXISTS (SELECT 1 FROM memory_conflicts c WHERE c.matched_id = m.id AND c.score IS NULL) AS unread, m.reviewed_at < TIMESTAMP '2026-01-01' AS seen_stale FROM memory m WHERE coalesce(m.status, '') <> 'superseded'""")
def _(s, d):
    agents = T(s, d, "memory").where("coalesce(status, '') <> 'superseded'").select("id", "reviewed_at")
    unread = T(s, d, "memory_conflicts").where("score IS NULL").select(F.col("matched_id").alias("id"))
    return C.peeked(agents, unread, "id", "reviewed_at", "2026-01-01").select("id", "unread", "seen_stale")


@query("msc_21_extraction_gate", "SELECT user_id, count(*) AS turns FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING count(*) >= 5 AND (user_id % 3 < 2 OR count(*) >= 100)")
def _(s, d):
    turns = T(s, d, "events").where("event_type <> 'view'").select("user_id")
    marks = turns.distinct().where("user_id % 3 > 0").select("user_id", (50 * (F.col("user_id") % 3) - 50).alias("done"))
    return I.due_sessions(turns, marks, "user_id", 5, 50).select("user_id", "turns")


# -- plug-ins ---------------------------------------------------------------------------------------------------------


@query("udf_01_tokenizer", f"SELECT id, list_filter(string_split_regex({low('title')}, '[^a-z0-9]+'), lambda w: w <> '')[1] AS first FROM meetings WHERE regexp_matches(title, '[A-Za-z0-9]')")
def _(s, d):
    """The tokenizer as a table function of SQL; without stems and parts its terms are the plain words."""
    R.register(s)
    T(s, d, "meetings").createOrReplaceTempView("udf_01_meetings")
    return s.sql("SELECT m.id, t.term AS first FROM udf_01_meetings m, LATERAL word_terms(m.title, false, false) t WHERE t.pos = 0")


@query("udf_02_distance", f"SELECT tbl, id, round(1 - list_cosine_similarity(vec::DOUBLE[], vec::DOUBLE[]), 6) AS distance FROM reembed_staging WHERE {good_sql('vec')}")
def _(s, d):
    R.register(s)
    good(T(s, d, "reembed_staging"), "vec").createOrReplaceTempView("udf_02_vectors")
    return s.sql("SELECT tbl, id, round(abs(vec_distance_cosine(vec, vec)), 6) AS distance FROM udf_02_vectors")


@query("udf_03_bm25_snippet", f"WITH {bm25_sql('documents', 'doc_id', DOCS.weights, ['retry', 'queue'], True)} SELECT doc, round(score, 6) AS score, CASE WHEN regexp_matches({low('text')}, '(^|\\s)[^a-z0-9\\s]*(retry|queue)') THEN TRUE END AS found FROM (SELECT * FROM b ORDER BY b.score, doc LIMIT 10) JOIN documents ON doc_id = doc")
def _(s, d):
    docs = T(s, d, "documents")
    top = FT.scan_bm25(docs, DOCS, [["retry"], ["queue"]]).orderBy("score", "doc").limit(10)
    shown = top.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").withColumn("snippet", R.snippet(F.col("text"), "retry queue"))
    return shown.select("doc", F.round("score", 6).alias("score"), F.when(F.contains(X.ascii_lower("snippet"), F.lit("retry")) | F.contains(X.ascii_lower("snippet"), F.lit("queue")), True).alias("found"))


@query("udf_04_callbacks", "SELECT count(*) AS texts FROM memory WHERE trim(value, ' ') <> ''")
def _(s, d):
    """A model and a progress callback are parameters; the progress of all tasks adds up to the texts."""
    done = s.sparkContext.accumulator(0)
    last = {"n": 0}

    def progress(n: int) -> None:
        done.add(n - last["n"])
        last["n"] = n

    EM.embedded(T(s, d, "memory"), "id", "value", EM.Embedder(EM.letters), progress).write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(done.value,)], "texts long")


@query("udf_05_rankers", f"WITH {_SCORED} SELECT 'cosine' AS ranker, doc, row_number() OVER (ORDER BY score DESC, input_pos) AS place FROM q WHERE score IS NOT NULL UNION ALL SELECT 'keyword', doc, input_pos FROM q UNION ALL SELECT 'cosine-order', doc, row_number() OVER (ORDER BY score DESC NULLS LAST, input_pos) FROM q")
def _(s, d):
    hits = _hits(s, d).withColumns({"type": F.lit("memory"), "tier": F.lit(0), "tier_place": F.col("input_pos")})
    return E.ranked(hits, {k: v for k, v in E.rankers(F.lit(False)).items() if k != "current"}).select("ranker", "doc", F.col("place").cast("bigint").alias("place"))


@query("udf_06_distiller", "SELECT id, 'title/' || id AS key, title AS value FROM meetings WHERE trim(title, ' ') <> ''")
def _(s, d):
    """A distiller is a callable from prompt to reply; its reply is parsed like any other."""
    import json

    def distil(prompt: str) -> str:
        number, _, title = prompt.partition("\n")
        return "facts: " + json.dumps([{"key": f"title/{number}", "value": title}])

    m = T(s, d, "meetings").where("trim(title) <> ''").select("id", F.concat(F.col("id").cast("string"), F.lit("\n"), F.col("title")).alias("prompt"))
    return S.reply_facts(S.distilled(m, "id", "prompt", distil), "id", "reply").select("id", "key", "value")


@query("udf_07_sources", f"SELECT 'memory' AS source, count(*) AS hits FROM memory WHERE contains({low('key')}, 'retry') OR contains({low('value')}, 'retry') UNION ALL SELECT 'meetings', count(*) FROM meetings WHERE contains({low('title')}, 'retry') OR contains({low('notes')}, 'retry') OR contains({low('transcript')}, 'retry')")
def _(s, d):
    parts = [FT.substring_hits(T(s, d, t), src, "retry").agg(F.count("*").alias("hits")).select(F.lit(t).alias("source"), "hits") for t, src in (("memory", MEMORY), ("meetings", MEETINGS))]
    return parts[0].unionByName(parts[1])
