"""Scalar functions over the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.functions import dates as D
from tarnstone.functions import maths as M
from tarnstone.functions import text as X
from tarnstone.storage import table as T

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def low(c: str) -> str:
    return _LOW.format(c)


def tok(c: str) -> str:
    return f"list_filter(string_split_regex({low(c)}, '[^a-z0-9]+'), lambda w: w <> '')"


@query("str_05_stopwords", f"SELECT doc_id, len(list_filter({tok('text')}, lambda w: w IN ({', '.join(repr(w) for w in X.STOPWORDS)}))) AS stops FROM documents WHERE text IS NOT NULL")
def _(s, d):
    stop = F.array(*[F.lit(w) for w in X.STOPWORDS])
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.filter(X.simple_tokens("text"), lambda w: F.array_contains(stop, w))).cast("bigint").alias("stops"))


@query("str_06_word_parts")
def _(s, d):
    """Parts of the joined words of code chunks, with how often they occur."""
    words = T(s, d, "chunks").select(F.explode(F.expr(r"regexp_extract_all(chunk_text, '[A-Za-z0-9]*[a-z][A-Z][A-Za-z0-9]*', 0)")).alias("word")).groupBy("word").count()

    def run(batches):
        for pdf in batches:
            pdf["parts"] = [" ".join(X.word_parts(w)) for w in pdf["word"]]
            yield pdf[["word", "parts", "count"]]

    return words.mapInPandas(run, "word string, parts string, count long").withColumnRenamed("count", "n")


@query("str_08_tokenizer")
def _(s, d):
    """Distinct stemmed terms of titles with the number of documents that have them."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, t) for i, x in zip(pdf["doc_id"], pdf["title"], strict=True) for t in {t for _, t, _ in X.tokens(x)}]
            yield pd.DataFrame(rows, columns=["doc_id", "term"])

    t = T(s, d, "documents").where("title IS NOT NULL").select("doc_id", "title").mapInPandas(run, "doc_id long, term string")
    return t.groupBy("term").agg(F.count("*").alias("df"))


@query("str_09_truncate", "SELECT id, CASE WHEN length(value) > 40 THEN substring(value, 1, 40) || '...' ELSE value END AS head FROM memory WHERE value IS NOT NULL")
def _(s, d):
    return T(s, d, "memory").where("value IS NOT NULL").select("id", X.truncate("value", 40).alias("head"))


@query("str_11_excerpt", f"""
WITH t AS (SELECT doc_id, text, greatest(CASE WHEN strpos({low('text')}, 'retry queue') > 0 THEN strpos({low('text')}, 'retry queue') ELSE strpos({low('text')}, 'retry') END - 30, 1) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN a > 1 THEN '...' ELSE '' END || substring(text, a, 90) || CASE WHEN length(text) > a + 89 THEN '...' ELSE '' END AS excerpt FROM t""")
def _(s, d):
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.excerpt("text", "Retry queue", 90).alias("excerpt"))


@query("str_14_context", r"SELECT id, nullif(substring(trim(regexp_replace(context, '\s+', ' ', 'g')), 1, 200), '') AS context FROM chunks")
def _(s, d):
    return T(s, d, "chunks").select("id", X.context("context").alias("context"))


@query("str_15_passage", "SELECT id, CASE WHEN nullif(context, '') IS NULL THEN chunk_text ELSE context || chr(10) || chr(10) || chunk_text END AS passage FROM chunks")
def _(s, d):
    return T(s, d, "chunks").select("id", X.passage("context", "chunk_text").alias("passage"))


@query("str_16_chunk_text")
def _(s, d):
    return X.chunks_frame(T(s, d, "documents"), "doc_id", "text")


@query("str_19_chunk_by_lines", r"""
WITH l AS (SELECT id, string_split(regexp_replace(regexp_replace(chunk_text, '\r(\n|\z)', '\1', 'g'), '\n\z', ''), chr(10)) AS l FROM chunks WHERE chunk_text IS NOT NULL),
g AS (SELECT id, l, unnest(range(CASE WHEN len(l) <= 15 THEN 1 ELSE CAST(ceil((len(l) - 15) / 12) AS BIGINT) + 1 END)) AS k FROM l)
SELECT id, k AS chunk_no, k * 12 + 1 AS first_line, least(k * 12 + 15, len(l)) AS last_line FROM g""")
def _(s, d):
    text = F.regexp_replace(F.regexp_replace("chunk_text", r"\r(\n|\z)", "$1"), r"\n\z", "")
    l = T(s, d, "chunks").where("chunk_text IS NOT NULL").select("id", F.size(F.split(text, "\n")).cast("bigint").alias("n"))
    last = F.when(F.col("n") <= 15, F.lit(0)).otherwise(F.ceil((F.col("n") - 15) / 12)).cast("bigint")
    k = l.select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no"))
    return k.select("id", "chunk_no", (F.col("chunk_no") * 12 + 1).alias("first_line"), F.least(F.col("chunk_no") * 12 + 15, F.col("n")).alias("last_line"))


@query("str_20_split_code")
def _(s, d):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, k, a, b) for i, t in zip(pdf["id"], pdf["chunk_text"], strict=True) for k, (a, b, _) in enumerate(X.split_code(t, 800))]
            yield pd.DataFrame(rows, columns=["id", "piece", "first", "last"])

    return T(s, d, "chunks").where("chunk_text IS NOT NULL").select("id", "chunk_text").mapInPandas(run, "id long, piece int, first int, last int")


@query("str_21_code_kind", "SELECT DISTINCT kind, replace(regexp_replace(kind || '_item', '_(item|declaration|definition|specifier)$', ''), '_', ' ') AS words FROM documents")
def _(s, d):
    return T(s, d, "documents").select("kind", X.code_kind(F.concat("kind", F.lit("_item"))).alias("words")).distinct()


@query("str_22_slugify", f"SELECT id, coalesce(nullif(regexp_replace(regexp_replace({low('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') AS slug FROM meetings WHERE title IS NOT NULL")
def _(s, d):
    return T(s, d, "meetings").where("title IS NOT NULL").select("id", X.slug("title").alias("slug"))


@query("str_23_key_path", f"SELECT id, array_to_string(list_transform(string_split(key, '/'), lambda k: coalesce(nullif(regexp_replace(regexp_replace({low('k')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed')), '/') AS path FROM memory")
def _(s, d):
    return T(s, d, "memory").select("id", X.key_path("key").alias("path"))


@query("str_26_without_private", r"SELECT doc_id, length(regexp_replace(replace(text, 'the ', '<Private>x</private>'), '(?s)<[Pp]rivate>.*?(?:</private>|\z)', '', 'g')) AS n FROM documents WHERE text IS NOT NULL")
def _(s, d):
    marked = F.replace("text", F.lit("the "), F.lit("<Private>x</private>"))
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.char_length(X.without_private(marked)).cast("bigint").alias("n"))


@query("str_27_project_hash", r"SELECT id, regexp_replace(path, '[^\p{L}\p{N}-]', '-', 'g') AS hash FROM repos")
def _(s, d):
    return T(s, d, "repos").select("id", X.project_hash("path").alias("hash"))


@query("str_29_significant", f"SELECT id, len(list_distinct(list_filter(string_split_regex(lower(value), '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 3 AND w NOT IN ({', '.join(repr(w) for w in X.DUPLICATE_STOPWORDS)})))) AS n FROM memory WHERE value IS NOT NULL")
def _(s, d):
    return T(s, d, "memory").where("value IS NOT NULL").select("id", F.size(X.significant_tokens("value")).cast("bigint").alias("n"))


@query("str_30_signature", r"SELECT id, regexp_replace(string_split(chunk_text, chr(10))[1], '\s*\{\s*$', '') AS signature FROM chunks WHERE chunk_text IS NOT NULL")
def _(s, d):
    return T(s, d, "chunks").where("chunk_text IS NOT NULL").select("id", X.signature("chunk_text").alias("signature"))


@query("str_31_first_line", r"SELECT id, CASE WHEN length(l) > 50 THEN substring(l, 1, 50) || '...' ELSE l END AS line FROM (SELECT id, trim(regexp_replace(string_split(value, chr(10))[1], '\s+$', '')) AS l FROM memory WHERE value IS NOT NULL)")
def _(s, d):
    return T(s, d, "memory").where("value IS NOT NULL").select("id", X.first_line("value", 50).alias("line"))


@query("str_32_probe_windows", """
WITH t AS (SELECT id, transcript AS x, greatest(length(transcript) - 400, 0) AS span FROM meetings WHERE transcript IS NOT NULL),
w AS (SELECT DISTINCT id, x, CAST(floor(span * i / 7) AS BIGINT) + 1 AS a FROM t, range(8) r(i))
SELECT id, a AS start, md5(substring(x, a, 400)) AS probe FROM w""")
def _(s, d):
    m = T(s, d, "meetings").where("transcript IS NOT NULL")
    span = F.greatest(F.char_length("transcript") - 400, F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.floor(span * i / 7) + 1))
    both = m.select("id", F.explode(F.arrays_zip(starts.alias("a"), X.probe_windows("transcript", 400, 8).alias("w"))).alias("z"))
    return both.select("id", F.col("z.a").alias("start"), F.md5(F.col("z.w").cast("binary")).alias("probe"))


@query("str_36_concat_update", "SELECT id, value || chr(10) || '[stale: moved]' AS value, coalesce(tags, '') || chr(10) || 'Resolved: yes' AS notes FROM memory WHERE value IS NOT NULL")
def _(s, d):
    return T(s, d, "memory").where("value IS NOT NULL").select("id", F.concat("value", F.lit("\n[stale: moved]")).alias("value"), F.concat(F.coalesce("tags", F.lit("")), F.lit("\nResolved: yes")).alias("notes"))


@query("str_37_names_query", "SELECT id FROM people WHERE lower(trim(name)) = 'vera lakifering' OR lower(trim(name)) IN (SELECT lower(trim(name)) FROM people WHERE id = 3)")
def _(s, d):
    p = T(s, d, "people")
    third = p.where("id = 3").select(F.lower(F.trim("name")).alias("n"))
    named = p.withColumn("n", F.lower(F.trim("name")))
    return named.where(X.names_query("name", "Vera Lakifering ")).select("id").unionByName(named.join(third, "n", "left_semi").select("id")).distinct()


@query("dat_03_read_stamp", r"""
SELECT id, CAST(date_trunc('second', TRY_CAST(regexp_replace(trim(updated_at), 'Z$', '') AS TIMESTAMP)) AS VARCHAR) AS stamp FROM memory
WHERE TRY_CAST(regexp_replace(trim(updated_at), 'Z$', '') AS TIMESTAMP) IS NOT NULL AND regexp_matches(trim(updated_at), '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?Z?)?$')""")
def _(s, d):
    m = T(s, d, "memory").select("id", D.read_stamp(F.col("updated_at")).alias("stamp")).where("stamp IS NOT NULL")
    return m.select("id", F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("dat_05_cut_offs", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-30' - INTERVAL 90 MINUTE GROUP BY 1")
def _(s, d):
    ts = F.col("ts")
    return T(s, d, "events").where((ts >= D.before("2024-01-30", 7, "DAYS")) & (ts < D.before("2024-01-30", 90, "MINUTES"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("dat_06_epoch", "SELECT id, CAST(epoch_ms(CAST(id AS BIGINT) * 1000 + 1700000000000) AS VARCHAR) AS stamp FROM memory")
def _(s, d):
    at = D.from_millis(F.col("id") * 1000 + 1700000000000)
    return T(s, d, "memory").select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("mth_01_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    e = T(s, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(M.cosine(F.col("x"), F.col("y")), 6).alias("score"))


@query("mth_03_rrf", "SELECT doc_id, round(1 / (60 + row_number() OVER (PARTITION BY kind ORDER BY doc_id)), 9) AS score FROM documents")
def _(s, d):
    from pyspark.sql import Window as W

    return T(s, d, "documents").select("doc_id", F.round(M.rrf(F.row_number().over(W.partitionBy("kind").orderBy("doc_id"))), 9).alias("score"))


@query("mth_06_estimate_tokens", "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", M.estimate_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query("mth_08_clamp", "SELECT id, least(greatest(score * 1.5 - 0.2, 0), 1) AS score FROM memory_conflicts WHERE score IS NOT NULL")
def _(s, d):
    return T(s, d, "memory_conflicts").where("score IS NOT NULL").select("id", M.unit(F.col("score") * 1.5 - 0.2).alias("score"))


@query("mth_09_percent", "SELECT id, CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR) AS percent FROM memory_conflicts WHERE score IS NOT NULL")
def _(s, d):
    c = T(s, d, "memory_conflicts").where("score IS NOT NULL")
    return c.select("id", M.percent(F.col("score")).alias("percent"))


@query("arr_01_tags", "SELECT id, array_to_string(list_transform(string_split(replace(replace(replace(tags, '[', ''), ']', ''), '\"', ''), ','), lambda t: trim(t)), '|') AS tags FROM memory WHERE tags IS NOT NULL")
def _(s, d):
    flat = F.regexp_replace("tags", r'[\[\]"]', "")
    return T(s, d, "memory").where("tags IS NOT NULL").select("id", F.array_join(F.transform(F.split(flat, ","), lambda t: F.trim(t)), "|").alias("tags"))


@query("arr_02_links", "SELECT id, len(list_filter(from_json(tags, '[\"VARCHAR\"]'), lambda t: t <> 'harbor')) + 1 AS n FROM memory WHERE json_valid(tags)")
def _(s, d):
    links = F.filter(F.from_json("tags", "array<string>"), lambda t: t != "harbor")
    return T(s, d, "memory").where("json_array_length(tags) IS NOT NULL").select("id", F.size(F.concat(links, F.array(F.lit("new")))).cast("bigint").alias("n"))


@query("arr_04_json_each", "SELECT tag, count(*) AS n FROM (SELECT unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM memory WHERE json_valid(tags)) GROUP BY tag")
def _(s, d):
    return T(s, d, "memory").select(F.explode(F.from_json("tags", "array<string>")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("arr_05_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return T(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("hsh_01_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash"))


_SPLIT = r"string_split_regex({0}, '[ \t\n\r\f]+')"
_TERMS = f"list_filter(list_transform({_SPLIT}, lambda w: replace(w, '\"', '')), lambda w: w <> '')"
_STOP = ", ".join(repr(w) for w in X.STOPWORDS)
_BARE_SQL = r"lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"


@query("str_01_sanitize", f"SELECT doc_id, md5(array_to_string({_TERMS.format('text')}, '|')) AS terms FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.array_join(X.terms_of("text"), "|")).alias("terms"))


@query("str_02_loose_terms", f"""
WITH t AS (SELECT doc_id, {_TERMS.format('title')} AS t FROM documents WHERE title IS NOT NULL UNION ALL SELECT -item_id, {_TERMS.format('text')} FROM eval_items),
k AS (SELECT doc_id, t, list_filter(t, lambda w: {_BARE_SQL} <> '') AS w, list_filter(t, lambda w: {_BARE_SQL} <> '' AND {_BARE_SQL} NOT IN ({_STOP})) AS k FROM t),
f AS (SELECT doc_id, t, CASE WHEN len(k) > 0 THEN k ELSE w END AS k FROM k)
SELECT doc_id, CASE WHEN NOT (len(k) = 0 OR (len(t) = 1 AND len(k) = 1)) THEN array_to_string(k, '|') END AS terms FROM f""")
def _(s, d):
    q = T(s, d, "documents").where("title IS NOT NULL").select("doc_id", F.col("title").alias("q")).unionByName(T(s, d, "eval_items").select((-F.col("item_id")).alias("doc_id"), F.col("text").alias("q")))
    return q.select("doc_id", F.array_join(X.loose_terms_of("q"), "|").alias("terms"))


@query("str_03_code_terms", rf"""
WITH t AS (SELECT item_id, list_filter({_SPLIT.format('text')}, lambda w: w <> '') AS t FROM eval_items WHERE text IS NOT NULL)
SELECT item_id, array_to_string(CASE WHEN len(t) < 2 THEN [] ELSE list_slice(list_filter(list_transform(t, lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g'))), lambda w, i: length(w) >= 3 AND w NOT IN ({_STOP}) AND list_position(list_transform(t, lambda v: lower(regexp_replace(v, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g'))), w) = i), 1, 16) END, '|') AS terms FROM t""")
def _(s, d):
    return T(s, d, "eval_items").where("text IS NOT NULL").select("item_id", F.array_join(X.code_terms_of("text"), "|").alias("terms"))


@query("str_04_trigram_terms", f"SELECT id, array_to_string(list_filter({_TERMS.format('value')}, lambda w: length(w) >= 3), '|') AS terms FROM memory WHERE value IS NOT NULL")
def _(s, d):
    return T(s, d, "memory").where("value IS NOT NULL").select("id", F.array_join(F.filter(X.terms_of("value"), lambda w: F.char_length(w) >= 3), "|").alias("terms"))


@query("str_10_truncate_bytes", "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 60 THEN text ELSE left(text, list_max(list_filter(range(0, 61), lambda k: octet_length(encode(left(text, CAST(k AS INT)))) <= 60))) || '...' END AS head FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.truncated_bytes("text", 60).alias("head"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_WORDS_SQL = rf"w AS (SELECT doc_id, text, string_split({_FLAT}, ' ') AS p FROM documents WHERE text IS NOT NULL)"


def _snippet_sql(*terms: str) -> str:
    hit = " OR ".join(f"starts_with(regexp_replace({low('x')}, '^[^a-z0-9]+', ''), '{t}')" for t in terms)
    return f"{_WORDS_SQL}, h AS (SELECT *, list_position(list_transform(p, lambda x: {hit}), TRUE) AS pos FROM w), sn AS (SELECT doc_id, text, CASE WHEN pos > 0 THEN array_to_string(list_slice(p, greatest(pos - 6, 1), greatest(pos - 6, 1) + 19), ' ') END AS snippet FROM h)"


@query("str_12_snippet", f"WITH {_snippet_sql('retry', 'queue')} SELECT doc_id, snippet FROM sn WHERE snippet IS NOT NULL")
def _(s, d):
    from tarnstone.plans import reports as R

    return T(s, d, "documents").select("doc_id", R.snippet(F.col("text"), "retry queue").alias("snippet")).where("snippet IS NOT NULL")


@query("str_13_keyword_snippet", f"""
WITH {_snippet_sql('ail', 'digest')}, x AS (SELECT *, strpos({low('text')}, 'ail digest') AS w, strpos({low('text')}, 'ail') AS f FROM sn), y AS (SELECT *, greatest((CASE WHEN w > 0 THEN w ELSE f END) - 40, 1) AS a FROM x)
SELECT doc_id, coalesce(snippet, CASE WHEN w > 0 THEN CASE WHEN a > 1 THEN '...' ELSE '' END || substring(text, a, 120) || CASE WHEN length(text) > a + 119 THEN '...' ELSE '' END END, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END) AS snippet FROM y""")
def _(s, d):
    from tarnstone.plans import reports as R

    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", R.keyword_snippet(F.col("text"), "ail digest").alias("snippet"))


def _replaced(c: str, signs: dict[int, str]) -> str:
    for k, form in signs.items():
        c = f"replace({c}, chr({k}), '{form}')"
    return c


_YAML = {92: "\\\\", 34: '\\"', 10: "\\n", 13: "\\r", 9: "\\t", **{k: f"\\x{k:02x}" for k in X.CONTROLS if 0 < k < 128}}


@query("str_24_yaml_quote", f"SELECT doc_id, md5('\"' || {_replaced('text', _YAML)} || '\"') AS quoted FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.yaml_quoted("text").cast("binary")).alias("quoted"))


_REMOTES = "CASE id % 6 WHEN 0 THEN 'git@Host.example:' || ltrim(path, '/') || '.git' WHEN 1 THEN 'https://Host.example:8443' || path || '.git/' WHEN 2 THEN 'ssh://git@Host.example' || path WHEN 3 THEN 'file://' || path WHEN 4 THEN path ELSE 'C:\\' || name END"


@query("str_25_normal_remote", rf"""
WITH u AS (SELECT id, {_REMOTES} AS u FROM repos), f AS (SELECT *, CASE WHEN regexp_matches(u, '{X.REMOTE_URL}') AND NOT starts_with(lower(u), 'file:') THEN '{X.REMOTE_URL}' WHEN NOT contains(u, '://') AND regexp_matches(u, '{X.REMOTE_SCP}') THEN '{X.REMOTE_SCP}' END AS form FROM u),
p AS (SELECT id, CASE WHEN form = '{X.REMOTE_URL}' THEN lower(regexp_extract(u, '{X.REMOTE_URL}', 1)) ELSE lower(regexp_extract(u, '{X.REMOTE_SCP}', 1)) END AS host, CASE WHEN form = '{X.REMOTE_URL}' THEN regexp_extract(u, '{X.REMOTE_URL}', 2) ELSE regexp_extract(u, '{X.REMOTE_SCP}', 2) END AS path, form FROM f)
SELECT id, CASE WHEN form IS NOT NULL THEN host || '/' || regexp_replace(trim(path, '/'), '\.git$', '') END AS out FROM p""")
def _(s, d):
    """Addresses in six written forms; paths of this machine have none."""
    form = F.col("id") % 6
    url = (
        F.when(form == 0, F.concat(F.lit("git@Host.example:"), F.regexp_replace("path", "^/+", ""), F.lit(".git")))
        .when(form == 1, F.concat(F.lit("https://Host.example:8443"), "path", F.lit(".git/"))).when(form == 2, F.concat(F.lit("ssh://git@Host.example"), "path"))
        .when(form == 3, F.concat(F.lit("file://"), "path")).when(form == 4, F.col("path")).otherwise(F.concat(F.lit("C:\\"), "name"))
    )
    return T(s, d, "repos").select("id", X.remote(url).alias("out"))


@query("str_28_terminal_safe", f"SELECT doc_id, md5({_replaced('text', {9: ' ', 13: chr(92) + 'u{d}', **{k: f'{chr(92)}u{{{k:x}}}' for k in X.CONTROLS if k > 0}})}) AS safe FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.safe_for_terminal("text").cast("binary")).alias("safe"))


_DAY, _MINUTE = r"'^\d{4}-\d{2}-\d{2}$'", r"'^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?$'"


@query("dat_01_bounds", f"""
WITH m AS (SELECT id, trim(meeting_date) AS q FROM meetings), b AS (SELECT id,
 CASE WHEN regexp_matches(q, {_DAY}) THEN q || ' 00:00:00' WHEN regexp_matches(q, {_MINUTE}) THEN regexp_extract(q, {_MINUTE}, 1) || ' ' || regexp_extract(q, {_MINUTE}, 2) || coalesce(nullif(regexp_extract(q, {_MINUTE}, 3), ''), ':00') END AS low,
 CASE WHEN regexp_matches(q, {_DAY}) THEN q || ' 23:59:59' WHEN regexp_matches(q, {_MINUTE}) THEN regexp_extract(q, {_MINUTE}, 1) || ' ' || regexp_extract(q, {_MINUTE}, 2) || coalesce(nullif(regexp_extract(q, {_MINUTE}, 3), ''), ':59') END AS high FROM m)
SELECT id, CASE WHEN TRY_CAST(low AS TIMESTAMP) IS NOT NULL THEN low END AS low, CASE WHEN TRY_CAST(high AS TIMESTAMP) IS NOT NULL THEN high END AS high FROM b""")
def _(s, d):
    low_, high = D.bounds_of(F.col("meeting_date"))
    return T(s, d, "meetings").select("id", low_.alias("low"), high.alias("high"))


@query("dat_02_ages", """
SELECT id, CAST(CASE id % 4 WHEN 0 THEN DATE '2026-03-31' - n WHEN 1 THEN DATE '2026-03-31' - 7 * n WHEN 2 THEN DATE '2026-03-31' - to_months(n) ELSE DATE '2026-03-31' - to_months(12 * n) END AS DATE) AS day FROM (SELECT id, CAST(id % 40 AS INT) AS n FROM memory)""")
def _(s, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in "dWmY"]), (F.col("id") % 4 + 1).cast("int"))
    return T(s, d, "memory").select("id", D.age_of((F.col("id") % 40).cast("int"), unit, "2026-03-31").alias("day"))


_M64 = "18446744073709551616::UHUGEINT"


@query("mth_10_split_mix", f"""
WITH a AS (SELECT event_id, ((event_id::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M64})::UBIGINT AS z FROM events),
b AS (SELECT event_id, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {_M64})::UBIGINT AS z FROM a),
c AS (SELECT event_id, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {_M64})::UBIGINT AS z FROM b)
SELECT event_id, CAST(xor(z, z >> 31) AS VARCHAR) AS value FROM c""")
def _(s, d):
    """The first number of the sequence that each row's id seeds."""

    def run(batches):
        for pdf in batches:
            pdf["value"] = [str(v) for v in M.split_mix_first(pdf["event_id"].to_numpy()).tolist()]
            yield pdf

    return T(s, d, "events").select("event_id").mapInPandas(run, "event_id long, value string")
