"""Search over all record types, with stems: the hits, their fusion, their order by cosine, and what fits a reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.functions import text as X
from tarnstone.plans import everywhere as G
from tarnstone.plans import fulltext as FT
from tarnstone.plans import fusion as FU
from tarnstone.plans import symbols as S
from tarnstone.queries.codebase import _LINE_HITS, _SYM
from tarnstone.queries.entries import good, good_sql
from tarnstone.queries.scalars import low
from tarnstone.queries.search import DOCS, MEETINGS, MEMORY
from tarnstone.storage import table as T

WORDS = "retry queue"
PEOPLE = FT.Source("id", {"name": 4.0, "email": 2.0, "notes": 1.0})
REPOS = FT.Source("id", {"name": 4.0, "description": 1.0})
#: Type, table, how it is searched, which rows it has and may show, its name column.
_DOCUMENT_KINDS = ("project", "todo", "investigation")
_TYPES = (
    ("memory", "memory", MEMORY, "TRUE", "coalesce(status = 'active', FALSE)", "key"),
    ("person", "people", PEOPLE, "TRUE", "TRUE", "name"),
    *((k, "documents", DOCS, f"kind = '{k}'", "TRUE", "title") for k in _DOCUMENT_KINDS[:1]),
    ("meeting", "meetings", MEETINGS, "TRUE", "TRUE", "title"),
    *((k, "documents", DOCS, f"kind = '{k}'", "TRUE", "title") for k in _DOCUMENT_KINDS[1:]),
    ("repo", "repos", REPOS, "TRUE", "TRUE", "name"),
)
_FLOORS = {"memory": (0.3, 0.25), **{k: (0.05, 0.2) for k in _DOCUMENT_KINDS}}


def kinds(s, d) -> list[G.Kind]:
    return [G.Kind(name, T(s, d, tab).where(has), source, title, F.expr(keep) if keep != "TRUE" else None) for name, tab, source, has, keep, title in _TYPES]


def vectors(s, d) -> list[G.Vectors]:
    m = good(T(s, d, "memory"), "embedding").select("id", "status", F.col("embedding").alias("vec"))
    e = T(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    doc = T(s, d, "documents").where(F.col("kind").isin(*_DOCUMENT_KINDS)).select(F.col("doc_id").alias("id"), F.col("kind").alias("type"))
    memory = m.where("status = 'active'").select(F.lit("memory").alias("type"), "id", "vec")
    documents = e.where("id <> 0").join(doc, "id").select("type", "id", "vec")
    return [G.Vectors(memory, m.orderBy("id").limit(1), *_FLOORS["memory"]), G.Vectors(documents, e.where("id = 0"), *_FLOORS["todo"])]


def code(s, d):
    """The lists of code: symbols and lines of all repositories, in the order they rank themselves."""
    chunks = T(s, d, "chunks")

    def symbols():
        found = S.symbol_hits(S.symbols(chunks, X.code_terms(WORDS)), WORDS)
        return S.code_rank(found, F.lit(0), F.col("class"), ["name", "symbol"], 50).select(F.col("symbol").alias("doc"), "place", "name")

    def lines():
        found = S.code_rank(S.line_hits(chunks, WORDS, 20), F.col("phrase"), F.lit(0), ["id", "n"], 20)
        return found.select((F.col("id") * S.LINE_KEYS + F.col("n")).alias("doc"), "place", F.lit(None).cast("string").alias("name"))

    return [("symbol", symbols), ("code", lines)]


def _terms(c: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace(strip_accents({c}), '\p{{M}}', '', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


#: The written forms of the two stems.
_FORMS = ("(term = 'retry' OR starts_with(term, 'retri'))", "(starts_with(term, 'queue') AND term <> 'queued')")


def stemmed_sql(p: str, table: str, source: FT.Source, has: str, keep: str) -> str:
    """CTEs of a search with stems, their names starting with ``p``; the last one is {p}u (doc, tier, place, score)."""
    key = source.key
    post = " UNION ALL ".join(f"SELECT {key} AS doc, {w} AS w, unnest({_terms(c)}) AS term FROM {p}t WHERE {c} IS NOT NULL" for c, w in source.weights.items())
    tf = " UNION ALL ".join(f"SELECT doc, {k} AS ph, sum(w) AS tf FROM {p}p WHERE {cond} GROUP BY doc" for k, cond in enumerate(_FORMS))
    sub = " OR ".join(f"coalesce(contains({low(c)}, '{WORDS}'), FALSE)" for c in source.like())
    return f"""
{p}t AS (SELECT * FROM {table} WHERE {has}), {p}k AS (SELECT {key} AS doc FROM {p}t WHERE {keep}), {p}p AS ({post}),
{p}n AS (SELECT (SELECT count(*) FROM {p}t) AS n, (SELECT count(*) FROM {p}p) / (SELECT count(*) FROM {p}t) AS mean), {p}h AS ({tf}),
{p}d AS (SELECT ph, count(*) AS df FROM {p}h GROUP BY ph), {p}l AS (SELECT doc, count(*) AS len FROM {p}p GROUP BY doc),
{p}b AS (SELECT h.doc, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS ph FROM {p}h h JOIN {p}d USING (ph) JOIN {p}l USING (doc), {p}n GROUP BY h.doc),
{p}0 AS (SELECT doc, 0 AS tier, row_number() OVER (ORDER BY score, doc) AS place, score FROM {p}b SEMI JOIN {p}k USING (doc) WHERE ph = 2),
{p}1 AS (SELECT doc, 1 AS tier, row_number() OVER (ORDER BY doc) AS place, NULL AS score FROM (SELECT {key} AS doc FROM {p}t WHERE {sub}) SEMI JOIN {p}k USING (doc)),
{p}2 AS (SELECT doc, 2 AS tier, row_number() OVER (ORDER BY score, doc) AS place, score FROM {p}b SEMI JOIN {p}k USING (doc) WHERE doc NOT IN (SELECT doc FROM {p}0) AND doc NOT IN (SELECT doc FROM {p}1)),
{p}u AS (SELECT * FROM {p}0 UNION ALL SELECT * FROM {p}1 WHERE doc NOT IN (SELECT doc FROM {p}0) UNION ALL SELECT * FROM {p}2 WHERE place <= 10)"""


_ALL_STEMMED = stemmed_sql("x", "documents", DOCS, "TRUE", "TRUE")


@query("fts_08_stemmed", f"WITH {_ALL_STEMMED} SELECT doc, tier, place, round(score, 6) AS score FROM xu")
def _(s, d):
    """Three tiers with stems: other forms of the words are found as well."""
    return FT.search(T(s, d, "documents"), DOCS, WORDS, stems=True).select("doc", "tier", "place", F.round("score", 6).alias("score"))


def _everything() -> str:
    ctes, lists, names = [], [], []
    for no, (name, tab, source, has, keep, title) in enumerate(_TYPES):
        p = f"{name[:3]}_"
        ctes.append(stemmed_sql(p, tab, source, has, keep))
        names.append(f"SELECT '{name}' AS type, {source.key} AS doc, {title} AS name FROM {p}t")
        if name not in _FLOORS:
            lists.append(f"SELECT '{name}' AS type, doc, 0 AS tier, tier * 1e9 + place AS tp, NULL AS score, {2 * no} AS no FROM {p}u")
            continue
        if name == "memory":
            q = f"(SELECT embedding FROM memory WHERE {good_sql('embedding')} ORDER BY id LIMIT 1)"
            ctes.append(f"{p}v AS (SELECT id AS doc, list_cosine_similarity(embedding::DOUBLE[], {q}::DOUBLE[]) AS score FROM {p}t WHERE {good_sql('embedding')} AND status = 'active')")
        else:
            q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
            ctes.append(f"{p}v AS (SELECT doc_id AS doc, list_cosine_similarity(e.embedding::DOUBLE[], {q}::DOUBLE[]) AS score FROM {p}t JOIN embeddings e ON e.vec_id = doc_id AND e.vec_id <> 0)")
        floor, margin = _FLOORS[name]
        ctes.append(f"{p}s AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS place, score FROM {p}v WHERE score >= greatest({floor}, (SELECT max(score) FROM {p}v) - {margin}) AND doc NOT IN (SELECT doc FROM {p}u) ORDER BY score DESC, doc LIMIT 25)")
        lists.append(f"SELECT '{name}' AS type, u.doc, 0 AS tier, tier * 1e9 + place AS tp, v.score, {2 * no} AS no FROM {p}u u LEFT JOIN {p}v v ON v.doc = u.doc")
        lists.append(f"SELECT '{name}', doc, 1, place, score, {2 * no + 1} FROM {p}s")
    hit = _SYM + """,
hs AS (SELECT *, contains(lower(name), 'retry queue') OR contains(lower(signature), 'retry queue') AS whole, CAST(contains(lower(name), 'retry') OR contains(lower(signature), 'retry') AS INT) + CAST(contains(lower(name), 'queue') OR contains(lower(signature), 'queue') AS INT) AS terms, CAST(contains(lower(name), 'retry') AS INT) + CAST(contains(lower(name), 'queue') AS INT) AS in_name FROM sy),
so AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY terms DESC, in_name DESC, name, symbol) AS p FROM hs WHERE NOT whole AND terms > 0),
sx AS (SELECT symbol AS doc, name, row_number() OVER (ORDER BY terms DESC, name, symbol) AS place FROM so WHERE p <= 10 ORDER BY place LIMIT 10)"""
    lines = _LINE_HITS.replace("l AS (SELECT id, repo_id", "l AS (SELECT id, repo_id", 1).replace("contains(lower(line), 'loose') AND contains(lower(line), 'alert') AND contains(lower(line), 'rule') AS whole", "contains(lower(line), 'retry') AND contains(lower(line), 'queue') AS whole").replace("CAST(contains(lower(line), 'loose') AS INT) + CAST(contains(lower(line), 'alert') AS INT) + CAST(contains(lower(line), 'rule') AS INT) AS terms", "CAST(contains(lower(line), 'retry') AS INT) + CAST(contains(lower(line), 'queue') AS INT) AS terms").replace("'loose alert rule'", "'retry queue'")
    ctes += [hit, lines + """,
lx AS (SELECT id * 100000 + n AS doc, row_number() OVER (ORDER BY whole DESC, CASE WHEN whole THEN -CAST(phrase AS INT) ELSE -terms END, id, n) AS place FROM ((SELECT * FROM lk WHERE whole ORDER BY phrase DESC, id, n LIMIT 20) UNION ALL (SELECT * FROM lk WHERE NOT whole ORDER BY terms DESC, id, n LIMIT 10)) ORDER BY place LIMIT 20)"""]
    lists += ["SELECT 'symbol', doc, 0, place, NULL, 90 FROM sx", "SELECT 'code', doc, 0, place, NULL, 91 FROM lx"]
    names.append("SELECT 'symbol', doc, name FROM sx")
    return f"""WITH {', '.join(ctes)},
al AS ({' UNION ALL '.join(lists)}), nm AS ({' UNION ALL '.join(names)}),
hi AS (SELECT al.*, nm.name, coalesce(lower(trim(nm.name)) = '{WORDS}', FALSE) AS named FROM al LEFT JOIN nm ON nm.type = al.type AND nm.doc = al.doc),
fu AS (SELECT *, CASE WHEN tier = 0 THEN 1 / (60 + row_number() OVER (PARTITION BY type, tier ORDER BY tp)) ELSE 0 END + CASE WHEN score IS NULL THEN 0 ELSE 1 / (60 + row_number() OVER (ORDER BY score DESC NULLS LAST, no, tp)) END AS rrf FROM hi),
pl AS (SELECT *, row_number() OVER (ORDER BY named DESC, round(rrf, 12) DESC, no, tp) AS place FROM fu)"""


_EVERYTHING = _everything()


def _searched(s, d, ranking):
    return G.search(kinds(s, d), vectors(s, d), code(s, d), WORDS, ranking)


@query("fus_01_fuse", _EVERYTHING + " SELECT type, doc, tier, round(rrf, 9) AS rrf, place FROM pl")
def _(s, d):
    return _searched(s, d, "fusion").select("type", "doc", "tier", F.round("rrf", 9).alias("rrf"), "place")


@query("fus_02_cosine_order", _EVERYTHING + " SELECT type, doc, row_number() OVER (ORDER BY score DESC NULLS LAST, no, tp) AS place FROM hi")
def _(s, d):
    return _searched(s, d, "cosine").select("type", "doc", "place")


@query("cmp_01_search", _EVERYTHING + ", bu AS (SELECT *, sum(ceil((16 + octet_length(encode(coalesce(name, '')))) / 4)) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM pl WHERE place <= 20) SELECT type, doc, place FROM bu WHERE place = 1 OR used <= 150")
def _(s, d):
    """What a search shows: the best hits of all types up to a number and a budget of tokens."""
    hit = _searched(s, d, "fusion")
    size = F.ceil((16 + F.octet_length(F.coalesce("name", F.lit("")))) / 4)
    return FU.limited(hit, 20, 150, size).select("type", "doc", "place")


@query("cmp_02_code", _EVERYTHING + " SELECT type, doc, place FROM (SELECT 'symbol' AS type, doc, place FROM sx UNION ALL SELECT 'code', doc, place FROM lx)")
def _(s, d):
    """Code search gives its lists side by side, not fused."""
    (a, symbols), (b, lines) = code(s, d)
    return symbols().select(F.lit(a).alias("type"), "doc", "place").unionByName(lines().select(F.lit(b).alias("type"), "doc", "place"))
