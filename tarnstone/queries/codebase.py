"""Symbols, calls and code search over the chunks of the repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnstone.catalog import query
from tarnstone.plans import symbols as S
from tarnstone.storage import table as T

_NOISE = ", ".join(repr(n) for n in S.NOISE)
_CODE = "regexp_matches(file_path, '\\.(rs|py|ts|go|js|java)$')"
_SYM = rf"""
cl AS (SELECT id, repo_id, file_path, last_modified, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT *, string_split(regexp_replace(regexp_replace(chunk_text, '\r(\n|\z)', '\1', 'g'), '\n\z', ''), chr(10)) AS x FROM chunks WHERE chunk_text IS NOT NULL AND {_CODE})),
df AS (SELECT *, regexp_extract(line, '{S.DEFINITION}', 1) AS kind, nullif(regexp_extract(line, '{S.DEFINITION}', 2), '') AS name FROM cl),
sy AS (SELECT id * 100000 + n AS symbol, id, repo_id, file_path, last_modified, n, kind, name, regexp_replace(trim(line), '\s*\{{\s*$', '') AS signature FROM df WHERE name IS NOT NULL)"""
_CALLS = rf"""{_SYM},
ow AS (SELECT id, n, line, name, last_value(name IGNORE NULLS) OVER (PARTITION BY id ORDER BY n) AS caller, last_value(CASE WHEN name IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n) AS pos FROM df),
ca AS (SELECT DISTINCT id * 100000 + pos AS symbol, caller, to_name FROM (SELECT *, unnest(regexp_extract_all(line, '{S.CALL}', 1)) AS to_name FROM ow WHERE caller IS NOT NULL) WHERE to_name NOT IN ({_NOISE}) AND name IS DISTINCT FROM to_name)"""


def _symbols(s, d):
    return S.symbols(T(s, d, "chunks"))


def _calls(s, d):
    return S.calls(T(s, d, "chunks"))


@query("src_07_symbols", f"WITH {_SYM} SELECT symbol, id, kind, name, signature FROM sy")
def _(s, d):
    """Definitions of every language with a written form of its own; see ``src_07_python`` for the parser."""
    return _symbols(s, d).select("symbol", "id", "kind", "name", "signature")


@query("src_07_calls", f"WITH {_CALLS} SELECT symbol, caller, to_name FROM ca")
def _(s, d):
    return _calls(s, d)


@query("jon_06_symbols_files", f"WITH {_SYM}, f AS (SELECT repo_id, file_path, max(last_modified) AS changed FROM chunks GROUP BY 1, 2) SELECT symbol, name, f.file_path, changed FROM sy JOIN f ON f.repo_id = sy.repo_id AND f.file_path = sy.file_path")
def _(s, d):
    files = T(s, d, "chunks").groupBy("repo_id", "file_path").agg(F.max("last_modified").alias("changed"))
    return _symbols(s, d).join(files, ["repo_id", "file_path"]).select("symbol", "name", "file_path", "changed")


@query("jon_07_callers", f"WITH {_CALLS} SELECT ca.to_name AS callee, ca.caller, sy.file_path FROM ca JOIN sy ON sy.symbol = ca.symbol")
def _(s, d):
    return _calls(s, d).join(_symbols(s, d).select("symbol", "file_path"), "symbol").select(F.col("to_name").alias("callee"), "caller", "file_path")


@query("jon_25_first_match", f"WITH {_CALLS} SELECT ca.symbol, ca.to_name, k.first FROM ca LEFT JOIN (SELECT name, min(symbol) AS first FROM sy GROUP BY name) k ON k.name = ca.to_name")
def _(s, d):
    first = _symbols(s, d).groupBy(F.col("name").alias("to_name")).agg(F.min("symbol").alias("first"))
    return _calls(s, d).join(first, "to_name", "left").select("symbol", "to_name", "first")


_POPULAR = "(SELECT min(to_name) FROM ca WHERE to_name IN (SELECT name FROM sy))"


def _popular(s, d) -> str:
    """The first name, in order, that is both called and defined."""
    row = _calls(s, d).join(_symbols(s, d).select(F.col("name").alias("to_name")).distinct(), "to_name", "left_semi").agg(F.min("to_name")).first()
    return row[0] or ""


@query("grf_01_callees", f"WITH {_CALLS} SELECT DISTINCT caller, to_name FROM ca WHERE caller IN (SELECT name FROM sy WHERE starts_with(name, 'replace_'))")
def _(s, d):
    return _calls(s, d).where("startswith(caller, 'replace_')").select("caller", "to_name").distinct()


@query("grf_02_callers", f"WITH {_CALLS} SELECT ca.symbol, ca.caller, sy.file_path, sy.kind FROM ca JOIN sy ON sy.symbol = ca.symbol WHERE ca.to_name = {_POPULAR}")
def _(s, d):
    name = _popular(s, d)
    return _calls(s, d).where(F.col("to_name") == name).join(_symbols(s, d).select("symbol", "file_path", "kind"), "symbol").select("symbol", "caller", "file_path", "kind")


_RESOLVED = "re AS (SELECT ca.symbol, ca.caller, ca.to_name, l.target FROM ca JOIN sy ON sy.symbol = ca.symbol LEFT JOIN (SELECT repo_id, file_path, name, max(symbol) AS target FROM sy GROUP BY 1, 2, 3) l ON l.repo_id = sy.repo_id AND l.file_path = sy.file_path AND l.name = ca.to_name)"


@query("grf_03_calls", f"WITH {_CALLS}, {_RESOLVED} SELECT symbol, to_name, target, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS state FROM re")
def _(s, d):
    r = S.resolved(_calls(s, d), _symbols(s, d))
    return r.select("symbol", "to_name", "target", F.when(F.col("target").isNull(), "unresolved").otherwise("resolved").alias("state"))


@query("grf_04_bfs", f"""
WITH RECURSIVE {_CALLS}, e AS (SELECT DISTINCT caller, to_name FROM ca),
g(name, depth) AS (SELECT (SELECT min(caller) FROM e), 0 UNION SELECT e.to_name, g.depth + 1 FROM g JOIN e ON e.caller = g.name WHERE g.depth < 3)
SELECT name, min(depth) AS depth, name IN (SELECT name FROM sy) AS known FROM g WHERE name IS NOT NULL GROUP BY name""")
def _(s, d):
    e = _calls(s, d)
    first = e.agg(F.min("caller")).first()[0]
    return S.graph_of_names(e, _symbols(s, d), first or "", 3)


@query("grf_06_edge_dedup", f"WITH {_CALLS} SELECT caller, count(DISTINCT to_name) AS n FROM ca GROUP BY caller")
def _(s, d):
    return _calls(s, d).groupBy("caller").agg(F.count_distinct("to_name").alias("n"))


@query("grf_07_resolution", f"WITH {_SYM} SELECT repo_id, file_path, name, max(symbol) AS symbol FROM sy GROUP BY 1, 2, 3")
def _(s, d):
    return _symbols(s, d).groupBy("repo_id", "file_path", "name").agg(F.max("symbol").alias("symbol"))


_HITS = f"""{_SYM},
hs AS (SELECT *, contains(lower(name), 'cache retry') OR contains(lower(signature), 'cache retry') AS whole, CAST(contains(lower(name), 'cache') OR contains(lower(signature), 'cache') AS INT) + CAST(contains(lower(name), 'retry') OR contains(lower(signature), 'retry') AS INT) AS terms, CAST(contains(lower(name), 'cache') AS INT) + CAST(contains(lower(name), 'retry') AS INT) AS in_name FROM sy),
so AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY terms DESC, in_name DESC, name, symbol) AS p FROM hs WHERE NOT whole AND terms > 0),
ha AS (SELECT symbol, name, TRUE AS whole, terms, CASE WHEN name = 'cache retry' THEN 0 WHEN lower(name) = 'cache retry' THEN 1 WHEN starts_with(lower(name), 'cache retry') THEN 2 WHEN contains(lower(name), 'cache retry') THEN 3 ELSE 4 END AS class FROM hs WHERE whole
 UNION ALL SELECT symbol, name, FALSE, terms, 4 FROM so WHERE p <= 10)"""


@query("fus_04_symbols", f"WITH {_HITS} SELECT symbol, name, row_number() OVER (ORDER BY whole DESC, CASE WHEN whole THEN class ELSE -terms END, class, name, symbol) AS place FROM (SELECT * FROM ha WHERE whole UNION ALL (SELECT * FROM ha WHERE NOT whole ORDER BY terms DESC, class, name, symbol LIMIT 10)) ORDER BY place LIMIT 1000")
def _(s, d):
    hits = S.symbol_hits(_symbols(s, d), "cache retry")
    top = S.code_rank(hits, F.lit(0), F.col("class"), ["name", "symbol"], 1000)
    return top.select("symbol", "name", F.col("place").cast("bigint").alias("place"))


_ONE = _HITS.replace("cache retry", "raw_webhook").replace("'cache'", "'raw_webhook'").replace("'retry'", "'raw_webhook'")


@query("cmp_04_symbols", f"WITH {_SYM} SELECT symbol, name, CASE WHEN name = 'raw_webhook' THEN 0 WHEN lower(name) = 'raw_webhook' THEN 1 WHEN starts_with(lower(name), 'raw_webhook') THEN 2 WHEN contains(lower(name), 'raw_webhook') THEN 3 ELSE 4 END AS class FROM sy WHERE contains(lower(name), 'raw_webhook') OR contains(lower(signature), 'raw_webhook')")
def _(s, d):
    """Symbols of all repos whose name or signature holds the whole query; others are no match."""
    return S.symbol_hits(_symbols(s, d), "raw_webhook").where("whole").select("symbol", "name", "class")


_LINE_HITS = r"""
l AS (SELECT id, repo_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT id, repo_id, string_split(regexp_replace(regexp_replace(chunk_text, '\r(\n|\z)', '\1', 'g'), '\n\z', ''), chr(10)) AS x FROM chunks WHERE chunk_text IS NOT NULL)),
lh AS (SELECT *, contains(lower(line), 'loose') AND contains(lower(line), 'alert') AND contains(lower(line), 'rule') AS whole, CAST(contains(lower(line), 'loose') AS INT) + CAST(contains(lower(line), 'alert') AS INT) + CAST(contains(lower(line), 'rule') AS INT) AS terms, contains(lower(line), 'loose alert rule') AS phrase FROM l),
lp AS (SELECT *, row_number() OVER (PARTITION BY repo_id, whole ORDER BY phrase DESC, terms DESC, id, n) AS p FROM lh WHERE whole OR terms > 0),
lk AS (SELECT * FROM lp WHERE (whole AND p <= 20) OR (NOT whole AND p <= 10))"""


@query("fus_05_code_lines", f"WITH {_LINE_HITS} SELECT id, n, row_number() OVER (ORDER BY whole DESC, CASE WHEN whole THEN -CAST(phrase AS INT) ELSE -terms END, id, n) AS place FROM ((SELECT * FROM lk WHERE whole ORDER BY phrase DESC, id, n LIMIT 20) UNION ALL (SELECT * FROM lk WHERE NOT whole ORDER BY terms DESC, id, n LIMIT 10)) ORDER BY place LIMIT 20")
def _(s, d):
    hits = S.line_hits(T(s, d, "chunks"), "loose alert rule", 20)
    return S.code_rank(hits, F.col("phrase"), F.lit(0), ["id", "n"], 20).select("id", F.col("n").cast("bigint").alias("n"), F.col("place").cast("bigint").alias("place"))


@query("msc_20_code_refs", f"WITH {_CALLS} SELECT r.name AS repo, ca.to_name, count(*) AS refs FROM ca JOIN sy ON sy.symbol = ca.symbol JOIN repos r ON r.id = sy.repo_id GROUP BY 1, 2")
def _(s, d):
    r = T(s, d, "repos").select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
    return _calls(s, d).join(_symbols(s, d).select("symbol", "repo_id"), "symbol").join(r, "repo_id").groupBy("repo", "to_name").agg(F.count("*").alias("refs"))
