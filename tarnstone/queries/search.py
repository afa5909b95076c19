"""Keyword, vector, fused and code search over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.functions import text as X
from tarnstone.operators import ordering as O
from tarnstone.operators import predicates as P
from tarnstone.plans import code as C
from tarnstone.plans import fulltext as FT
from tarnstone.plans import fusion as FU
from tarnstone.plans import lexical as L
from tarnstone.plans import vectors as V
from tarnstone.queries.scalars import low, tok
from tarnstone.storage import table as T

DOCS = FT.Source("doc_id", {"title": 4.0, "text": 1.0})
MEMORY = FT.Source("id", {"key": 4.0, "value": 1.0, "memory_type": 1.0, "tags": 2.0}, ["key", "value"])
MEETINGS = FT.Source("id", {"title": 4.0, "transcript": 1.0, "notes": 1.0}, ["title", "notes", "transcript"])


def bm25_sql(table: str, key: str, weights: dict[str, float], phrases: list[str], every: bool) -> str:
    """The same score in SQL, for one-token phrases."""
    post = " UNION ALL ".join(f"SELECT {key} AS doc, '{c}' AS col, {w} AS w, unnest({tok(c)}) AS term FROM {table} WHERE {c} IS NOT NULL" for c, w in weights.items())
    likes = " UNION ALL ".join(f"SELECT doc, {k} AS ph, sum(w) AS tf FROM p WHERE starts_with(term, '{t}') GROUP BY doc" for k, t in enumerate(phrases))
    return f"""
p AS (SELECT * FROM ({post})), st AS (SELECT (SELECT count(*) FROM {table}) AS n, (SELECT count(*) FROM p) / (SELECT count(*) FROM {table}) AS mean),
h AS ({likes}), df AS (SELECT ph, count(*) AS df FROM h GROUP BY ph), ln AS (SELECT doc, count(*) AS len FROM p GROUP BY doc),
b AS (SELECT h.doc, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS ph
  FROM h JOIN df USING (ph) JOIN ln USING (doc), st GROUP BY h.doc {f'HAVING count(*) = {len(phrases)}' if every else ''})"""


_STRICT = f"WITH {bm25_sql('documents', 'doc_id', DOCS.weights, ['retry', 'queue'], True)} SELECT doc, round(score, 6) AS score FROM b"


@query("fts_strict", _STRICT)
def _(s, d):
    return FT.scan_bm25(T(s, d, "documents"), DOCS, FT.phrases(X.sanitize("retry queue"))).select("doc", F.round("score", 6).alias("score"))


@query("fts_01_postings", f"SELECT term, count(*) AS n FROM (SELECT unnest({tok('text')}) AS term FROM documents WHERE text IS NOT NULL UNION ALL SELECT unnest({tok('title')}) FROM documents WHERE title IS NOT NULL) GROUP BY term")
def _(s, d):
    return FT.postings(T(s, d, "documents"), DOCS).groupBy("term").agg(F.count("*").alias("n"))


@query("fts_02_phrase", rf"SELECT doc_id AS doc, CAST(len(regexp_extract_all({low('text')}, '(^|[^a-z0-9])dead[^a-z0-9]+lett')) AS BIGINT) AS hits FROM documents WHERE len(regexp_extract_all({low('text')}, '(^|[^a-z0-9])dead[^a-z0-9]+lett')) > 0")
def _(s, d):
    index = FT.postings(T(s, d, "documents"), FT.Source("doc_id", {"text": 1.0}))
    return FT.phrase_hits(index, FT.phrases(["dead-lett"])).select("doc", "hits")


@query("fts_03_any_term", f"WITH {bm25_sql('documents', 'doc_id', DOCS.weights, ['lighthouse', 'riddles'], False)} SELECT doc, ph AS phrases, round(score, 6) AS score FROM b")
def _(s, d):
    docs = T(s, d, "documents")
    return FT.bm25(FT.postings(docs, DOCS), docs, [["lighthouse"], ["riddles"]], DOCS.weights, every=False).select("doc", "phrases", F.round("score", 6).alias("score"))


@query("fts_04_bm25_memory", f"WITH {bm25_sql('memory', 'id', MEMORY.weights, ['index'], True)} SELECT doc, round(score, 6) AS score FROM b")
def _(s, d):
    return FT.scan_bm25(T(s, d, "memory"), MEMORY, [["index"]]).select("doc", F.round("score", 6).alias("score"))


@query("fts_05_filter_after", f"WITH {bm25_sql('memory', 'id', MEMORY.weights, ['cache', 'session'], True)} SELECT doc, round(score, 6) AS score FROM b JOIN memory m ON m.id = doc WHERE m.status = 'active'")
def _(s, d):
    m = T(s, d, "memory")
    hit = FT.scan_bm25(m, MEMORY, [["cache"], ["session"]])
    return hit.join(m.where("status = 'active'").select(F.col("id").alias("doc")), "doc", "left_semi").select("doc", F.round("score", 6).alias("score"))


@query("fts_06_substring", f"SELECT id AS doc FROM memory WHERE contains({low('key')}, 'ail-dig') OR contains({low('value')}, 'ail-dig')")
def _(s, d):
    return FT.substring_hits(T(s, d, "memory"), MEMORY, "ail-dig")


def _tier_sql(table, key, weights, likes, terms, loose, keep="TRUE"):
    sub = " OR ".join(f"contains({low(c)}, '{' '.join(terms)}')" for c in likes)
    return f"""
WITH kept AS (SELECT {key} AS doc FROM {table} WHERE {keep}),
s0 AS (WITH {bm25_sql(table, key, weights, terms, True)} SELECT doc, score FROM b),
s1 AS (SELECT {key} AS doc FROM {table} WHERE {sub}),
s2 AS (WITH {bm25_sql(table, key, weights, loose, False)} SELECT doc, score FROM b),
t01 AS (SELECT doc, 0 AS tier, row_number() OVER (ORDER BY score, doc) AS place, score FROM s0 SEMI JOIN kept USING (doc)),
t1 AS (SELECT doc, 1 AS tier, row_number() OVER (ORDER BY doc) AS place, NULL AS score FROM s1 SEMI JOIN kept USING (doc)),
t2 AS (SELECT doc, 2 AS tier, row_number() OVER (ORDER BY score, doc) AS place, score FROM s2 SEMI JOIN kept USING (doc) WHERE doc NOT IN (SELECT doc FROM t01) AND doc NOT IN (SELECT doc FROM t1)),
u AS (SELECT * FROM t01 UNION ALL SELECT * FROM t1 WHERE doc NOT IN (SELECT doc FROM t01) UNION ALL SELECT * FROM t2 WHERE place <= 10)"""


_TIERS = _tier_sql("documents", "doc_id", DOCS.weights, ["title", "text"], ["retry", "queue"], ["retry", "queue"])


@query("fts_07_three_tiers", _TIERS + "SELECT doc, tier, CAST(place AS BIGINT) AS place, round(score, 6) AS score FROM u")
def _(s, d):
    return FT.search(T(s, d, "documents"), DOCS, "retry queue").select("doc", "tier", F.col("place").cast("bigint").alias("place"), F.round("score", 6).alias("score"))


@query("fts_09_without_loose", _tier_sql("memory", "id", MEMORY.weights, ["key", "value"], ["search", "index"], ["search", "index"], "status = 'active'") + "SELECT doc, tier FROM u WHERE tier < 2")
def _(s, d):
    return FT.search(T(s, d, "memory"), MEMORY, "search index", keep=F.col("status") == "active", loose=False).select("doc", "tier")


_LINES = r"""l AS (SELECT id, unnest(x) AS line, generate_subscripts(x, 1) AS line_no FROM (SELECT id, string_split(regexp_replace(regexp_replace(chunk_text, '\r(\n|\z)', '\1', 'g'), '\n\z', ''), chr(10)) AS x FROM chunks WHERE chunk_text IS NOT NULL))"""


@query("fts_11_line_search", f"""
WITH {_LINES}, h AS (SELECT id, line_no, contains(lower(line), 'rate limiter') AS phrase FROM l WHERE contains(lower(line), 'rate') AND contains(lower(line), 'limiter')),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY phrase DESC, line_no) AS place FROM h)
SELECT id, CAST(line_no AS INTEGER) AS line_no, phrase, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def _(s, d):
    return C.line_search(T(s, d, "chunks"), ["id"], "chunk_text", "rate limiter")


@query("fts_12_any_term_lines", f"WITH {_LINES} SELECT id, CAST(line_no AS INTEGER) AS line_no, CAST(contains(lower(line), 'lease') AS INTEGER) + CAST(contains(lower(line), 'webhook') AS INTEGER) AS terms FROM l WHERE contains(lower(line), 'lease') OR contains(lower(line), 'webhook')")
def _(s, d):
    return C.any_term_lines(T(s, d, "chunks"), ["id"], "chunk_text", ["lease", "webhook"])


# -- vectors ----------------------------------------------------------------------------------------------------------

_SIM = "s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS score FROM embeddings WHERE vec_id <> 0)"


def _scored(s, d):
    e = T(s, d, "embeddings")
    return V.similar_to(e.where("vec_id <> 0"), e.where("vec_id = 0"), "embedding")


@query("vec_01_memory_similar", """
WITH q AS (SELECT embedding AS v FROM memory WHERE id = (SELECT min(id) FROM memory WHERE len(embedding) = 384 AND isfinite(list_sum(embedding)) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)),
s AS (SELECT id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM memory, q WHERE len(embedding) = 384 AND status = 'active' AND isfinite(list_sum(embedding)) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)
SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 25""")
def _(s, d):
    m = T(s, d, "memory").where(F.size("embedding") == 384)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    usable = m.withColumn("t", total).where("t > 0 AND t < double('Infinity')").drop("t")
    first = usable.orderBy("id").limit(1)
    return V.top_k(V.similar_to(usable.where("status = 'active'").select("id", "embedding"), first, "embedding"), 25, "id").select("id", F.round("score", 6).alias("score"))


@query("vec_02_best_chunk", f"WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS p FROM s) SELECT label, vec_id, round(score, 6) AS score FROM r WHERE p = 1 ORDER BY score DESC, vec_id LIMIT 5")
def _(s, d):
    return V.best_per_record(_scored(s, d), "label", "vec_id", 5).select("label", "vec_id", F.round("score", 6).alias("score"))


@query("vec_03_with_status", f"WITH {_SIM} SELECT vec_id, round(score, 6) AS score FROM s WHERE label IN (1, 3, 5) ORDER BY s.score DESC, vec_id LIMIT 10")
def _(s, d):
    return V.top_k(_scored(s, d).where("label IN (1, 3, 5)"), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("vec_05_repo_similar", f"WITH {_SIM} SELECT label, round(avg(score), 6) AS score FROM s GROUP BY label")
def _(s, d):
    return _scored(s, d).groupBy("label").agg(F.round(F.avg("score"), 6).alias("score"))


@query("vec_07_scores_of_hits", f"WITH {_SIM} SELECT vec_id, round(score, 6) AS score FROM s WHERE vec_id IN (SELECT doc_id FROM documents WHERE kind = 'code')")
def _(s, d):
    hits = T(s, d, "documents").where("kind = 'code'").select(F.col("doc_id").cast("int").alias("vec_id"))
    return _scored(s, d).join(hits, "vec_id", "left_semi").select("vec_id", F.round("score", 6).alias("score"))


@query("vec_08_near_duplicates", f"WITH {_SIM} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.3")
def _(s, d):
    return _scored(s, d).where("score >= 0.3").select("vec_id", F.round("score", 6).alias("score"))


@query("vec_09_lexical_duplicates", f"""
WITH t AS (SELECT id, list_distinct({tok('value')}) AS w FROM memory WHERE value IS NOT NULL AND status = 'active'),
q AS (SELECT id, w, list_transform(list_slice(list_sort(list_transform(w, lambda x: {{'n': -length(x), 'w': x}})), 1, 8), lambda x: x.w) AS probe FROM t WHERE id % 100 = 0)
SELECT q.id, t.id AS other, round(len(list_intersect(q.w, t.w)) / len(q.w), 6) AS score FROM q JOIN t ON t.id <> q.id AND list_has_any(q.probe, t.w) WHERE len(list_intersect(q.w, t.w)) / len(q.w) >= 0.7""")
def _(s, d):
    m = T(s, d, "memory").where("value IS NOT NULL AND status = 'active'").select("id", F.array_distinct(X.simple_tokens("value")).alias("w"))
    return L.holders(m, m.where("id % 100 = 0"), "id", "w", 0.7).select("id", "other", F.round("score", 6).alias("score"))


@query("vec_10_probes", """
WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS p FROM s)
SELECT qid AS query_key, vec_id, round(score, 6) AS score, CAST(p AS INTEGER) AS place FROM r WHERE p <= 10""")
def _(s, d):
    e = T(s, d, "embeddings").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    return V.nearest_records(e, e.where("vec_id % 100 = 0"), "embedding", "vec_id", 10).select("query_key", "vec_id", F.round("score", 6).alias("score"), "place")


# -- fusion -----------------------------------------------------------------------------------------------------------

_FUSE = f"""
{_TIERS}, e AS (SELECT vec_id AS doc, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS cos FROM embeddings WHERE vec_id <> 0),
k AS (SELECT 'document' AS type, u.doc, 0 AS tier, tier * 100000 + place AS tier_place, e.cos AS score FROM u LEFT JOIN e ON e.doc = u.doc),
v AS (SELECT 'document' AS type, doc, 1 AS tier, row_number() OVER (ORDER BY cos DESC, doc) AS tier_place, cos AS score FROM e WHERE doc NOT IN (SELECT doc FROM u) ORDER BY cos DESC, doc LIMIT 25),
h AS (SELECT *, tier * 1000000 + tier_place AS input_pos FROM (SELECT * FROM k UNION ALL SELECT * FROM v)),
r AS (SELECT *, CASE WHEN tier = 0 THEN 1 / (60 + row_number() OVER (PARTITION BY tier ORDER BY tier_place)) ELSE 0 END AS kw,
  CASE WHEN score IS NOT NULL THEN 1 / (60 + row_number() OVER (ORDER BY score DESC NULLS LAST, input_pos)) ELSE 0 END AS cs FROM h)"""


def _hits(s, d):
    kw = FT.search(T(s, d, "documents"), DOCS, "retry queue").select("doc", (F.col("tier") * 100000 + F.col("place")).alias("place"))
    e = _scored(s, d).select(F.col("vec_id").cast("bigint").alias("doc"), "score")
    sem = FU.semantic_only(e, kw)
    sem = sem.orderBy(F.col("score").desc(), "doc").limit(25).withColumn("g", F.lit(0))
    sem = O.first_per(sem, ["g"], F.col("score").desc(), F.col("doc"), n=25, rank="place")
    return FU.union_hits([("document", 0, kw.join(e, "doc", "left")), ("document", 1, sem)])


_SEARCH = _FUSE + """, o AS (SELECT doc, row_number() OVER (ORDER BY doc = 3 DESC, kw + cs DESC, input_pos) AS place FROM r),
g AS (SELECT o.doc, place, sum(ceil(least(length(x.text), 400) / 4)) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM o JOIN documents x ON x.doc_id = o.doc AND x.text IS NOT NULL WHERE place <= 20)
SELECT doc, place FROM g WHERE place = (SELECT min(place) FROM g) OR used <= 1200"""


@query("cmp_03_type_search", _tier_sql("meetings", "id", MEETINGS.weights, MEETINGS.substring, ["retro"], ["retro"]) + "SELECT doc, tier FROM u WHERE tier < 2 ORDER BY tier, place LIMIT 5")
def _(s, d):
    return FT.search(T(s, d, "meetings"), MEETINGS, "retro").orderBy("tier", "place").limit(5).select("doc", "tier")


# -- graph ------------------------------------------------------------------------------------------------------------


@query("grf_05_history", """
WITH RECURSIVE l AS (SELECT id AS a, CAST(superseded_by AS BIGINT) AS b FROM memory WHERE superseded_by IS NOT NULL AND superseded_by <> id AND superseded_by IN (SELECT id FROM memory)),
r(s, n) AS (SELECT id, id FROM memory UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.n)
SELECT s AS start, n AS node FROM r""")
def _(s, d):
    return C.supersession(T(s, d, "memory").select("id", F.col("superseded_by").cast("bigint").alias("heir")), "id", "heir")


@query("prd_17_margin", f"WITH {_SIM}, m AS (SELECT max(score) AS top FROM s WHERE score >= 0.1) SELECT vec_id, round(score, 6) AS score FROM s, m WHERE score >= greatest(0.1, top - 0.1)")
def _(s, d):
    return P.cut_off(_scored(s, d), [], 0.1, 0.1).select("vec_id", F.round("score", 6).alias("score"))


@query("fts_13_index_check", f"""
WITH p AS (SELECT id, 'key' AS col, unnest({tok('key')}) AS term FROM memory UNION ALL SELECT id, 'value', unnest({tok('value')}) FROM memory UNION ALL SELECT id, 'memory_type', unnest({tok('memory_type')}) FROM memory UNION ALL SELECT id, 'tags', unnest({tok('tags')}) FROM memory)
SELECT count(*) FILTER (id % 7 = 0) AS missing, count(*) FILTER (id % 5 = 0 AND id % 7 <> 0 AND col = 'key') AS extra FROM p""")
def _(s, d):
    """An index that lacks the rows of some records and still has old terms of others doesn't equal its records."""
    m = T(s, d, "memory")
    good = FT.postings(m, MEMORY)
    stale = good.where("doc % 5 = 0 AND doc % 7 <> 0 AND col = 'key'").withColumn("term", F.concat("term", F.lit("-old")))
    return FT.index_check(good.where("doc % 7 <> 0").unionByName(stale), m, MEMORY)
