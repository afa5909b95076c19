"""Sources: source files, sessions, markdown memories, distilled facts, evaluation queries; and admission rules."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnstone.functions.text import without_private

# File extensions of the languages with rules of their own.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "go": "go", "cs": "csharp", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp",
    "h": "cpp", "hpp": "cpp", "hxx": "cpp", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "php": "php",
    "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "md": "markdown", "mdx": "markdown",
}
# Folders that are never indexed.
IGNORED = (".git", "node_modules", "target", "__pycache__", ".venv", "vendor", "obj", "bin")
SKIPPED_NOTES = ("MEMORY", "AGENTS", "README", "INDEX")


def language(path: Column) -> Column:
    """The language of a path by its extension, null if there is no rule."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"\.")  # a name without a dot has no extension
    return F.when(F.size(parts) > 1, F.element_at(table, F.element_at(parts, -1)))


def indexable(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda p: p.isin(*IGNORED))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the files below a folder that may be indexed."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.where(indexable(F.col("path"))).select("path", "length", "content")


def admitted(rows: DataFrame, max_bytes: int) -> DataFrame:
    """(path, language, text): known languages, too large ones as plain text; unknown ones if small, UTF-8 and without NUL."""
    lang, content = language(F.col("path")), F.col("content")
    big = F.col("length") > max_bytes
    plain = F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.unhex(F.lit("00")))
    keep = F.when(lang.isNull(), ~big & plain).otherwise(F.lit(True))
    return rows.where(keep).select("path", F.when(lang.isNull() | big, "text").otherwise(lang).alias("language"), F.make_valid_utf8(content.cast("string")).alias("text"))


def python_symbols(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of the definitions of a Python file; none if it doesn't parse."""
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(kinds[type(n)], n.name, n.lineno, n.end_lineno or n.lineno) for n in ast.walk(tree) if type(n) in kinds]


def python_calls(source: str) -> list[tuple[str, str]]:
    """(caller, callee) of the calls inside the functions of a Python file, each pair once."""
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: dict[tuple[str, str], None] = {}
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for c in ast.walk(f):
                if isinstance(c, ast.Call):
                    name = c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id if isinstance(c.func, ast.Name) else None
                    if name:
                        out[(f.name, name)] = None
    return list(out)


def symbols(rows: DataFrame) -> DataFrame:
    """(path, kind, name, first, last) of the Python files among (path, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(p, *s) for p, t in zip(pdf["path"], pdf["text"], strict=True) for s in python_symbols(t)]
            yield pd.DataFrame(found, columns=["path", "kind", "name", "first", "last"])

    return rows.where("language = 'python' AND text IS NOT NULL").select("path", "text").mapInPandas(run, "path string, kind string, name string, first int, last int")


def _commits(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Lines of histories with the hash and the time of the commit they are of: the last line above them that opens one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("line").rlike("^commit [0-9a-f]+ [0-9]+$"), F.split("line", " "))
    rows = lines.withColumn("_head", head).withColumn("_of", F.last("_head", ignorenulls=True).over(w))
    return rows.select(*by, F.col("_head").isNotNull().alias("opens"), "line", F.col("_of")[1].alias("hash"), F.col("_of")[2].cast("long").alias("at"))


def commit_dates(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, path, at): when each path was last changed, from dumped histories (``commit HASH TIME``, then its paths)."""
    c = _commits(lines, by, order).where("NOT opens AND line <> '' AND hash IS NOT NULL")
    return c.groupBy(*by, F.col("line").alias("path")).agg(F.max("at").alias("at"))


def oldest_commit(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, hash, at): the first commit of each history; of those of one moment the one with the smaller hash."""
    c = _commits(lines, by, order).where("opens")
    first = c.groupBy(*by).agg(F.min(F.struct("at", "hash")).alias("_f"))
    return first.select(*by, F.col("_f.hash").alias("hash"), F.col("_f.at").alias("at"))


def name_status(lines: DataFrame, line: str) -> DataFrame:
    """(path, change) of a listing ``STATE<tab>path``; a rename or copy has two paths: the old one goes (not of a copy), the
    new one comes."""
    p = F.split(line, "\t")
    state = F.substring(p[0], 1, 1)
    one = lambda path, change: F.struct(path.alias("path"), change.alias("change"))
    both = F.when(state == "R", F.array(one(p[1], F.lit("D")), one(F.get(p, F.lit(2)), F.lit("A")))).when(state == "C", F.array(one(F.get(p, F.lit(2)), F.lit("A"))))
    return lines.select(F.explode(F.coalesce(both, F.array(one(p[1], state)))).alias("x")).select("x.path", "x.change")


EVAL_FIELDS = {"id": int, "kind": str, "text": str, "relevant": list}


def parsed_queries(file: str) -> list[dict[str, Any]]:
    """The queries of an evaluation file (TOML). Unknown or missing fields, wrong types and double ids are errors."""
    import tomllib

    data, out, seen = tomllib.loads(file), [], set()
    if unknown := set(data) - {"query"}:
        raise ValueError(f"unknown: {sorted(unknown)}")
    for q in data.get("query", []):
        if set(q) != set(EVAL_FIELDS):
            raise ValueError(f"fields of a query: {sorted(q)}")
        for name, kind in EVAL_FIELDS.items():
            if not isinstance(q[name], kind):
                raise ValueError(f"{name} of a query: {q[name]!r}")
        if q["id"] in seen or not q["text"].strip():
            raise ValueError(f"a query twice, or without a text: {q['id']}")
        seen.add(q["id"])
        out.append(q)
    return out


def eval_queries(files: DataFrame, column: str) -> DataFrame:
    """(id, kind, text, relevant) of the queries in evaluation files; a file with an error stops the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([q for f in pdf[column] for q in parsed_queries(f)], columns=list(EVAL_FIELDS))

    return files.select(column).mapInPandas(run, "id long, kind string, text string, relevant array<long>")


def text_bodies(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """(key, body): files read whole, one record each, without the line end of the last line; ``key`` is taken from the folder's name (key=value)."""
    return spark.read.option("wholetext", True).text(folder).select(key, F.regexp_replace("value", r"\n\z", "").alias("body"))


def setting(layers: list[Column], default: int, least: int, most: int) -> Column:
    """A number from the first layer that has one (flag, environment, file), else the default, brought into its range."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(*layers, F.lit(default))))


def content_text(content: Column, listed: Column, sep: str = " ") -> Column:
    """The text of a message whose content is a string or, where ``listed``, a JSON list of blocks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    return F.when(listed, F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), sep)).otherwise(content)


def distilled(prompts: DataFrame, key: str, prompt: str, call) -> DataFrame:
    """(key, reply): a distiller, given as a callable, asked once for each prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "reply": [call(p) for p in pdf[prompt]]})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} long, reply string")


def reply_facts(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """One row per fact of every reply: see ``distilled_facts``; a reply that can't be read stops the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "key", "value", "type", "supersedes", "repo_scope", "project"]
        for pdf in batches:
            rows = [(k, *f.values()) for k, r in zip(pdf["_k"], pdf["_r"], strict=True) for f in distilled_facts(r)]
            yield pd.DataFrame(rows, columns=names).astype({"project": "Int64"})

    slim = replies.select(F.col(key).alias("_k"), F.col(reply).alias("_r"))
    return slim.mapInPandas(run, f"{key} long, key string, value string, type string, supersedes string, repo_scope boolean, project long")


def session_turns(lines: DataFrame, cap_user: int = 500, cap_other: int = 1000) -> DataFrame:
    """(line, role, text, id, at) of session lines (line BIGINT, value STRING of JSON): text blocks joined, private parts out."""
    head = F.from_json("value", "struct<type:string,uuid:string,timestamp:string,message:struct<content:string>>")
    j = lines.withColumn("j", head).where("j.type IN ('user', 'assistant')")
    raw = F.col("j.message.content")
    blocks = F.from_json(raw, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
    listed = F.get_json_object("value", "$.message.content[0]").isNotNull()  # a string that starts with a bracket is none
    text = F.trim(without_private(F.when(listed, joined).otherwise(raw)))
    cap = F.when(F.col("j.type") == "user", F.lit(cap_user)).otherwise(F.lit(cap_other))
    return j.select("line", F.col("j.type").alias("role"), F.substring(text, F.lit(1), cap).alias("text"), F.col("j.uuid").alias("id"), F.col("j.timestamp").alias("at")).where("text <> ''")


def turn_count(lines: DataFrame) -> DataFrame:
    """Turns of a session by a cheap look at each line."""
    hit = F.contains("value", F.lit('"type":"user"')) | F.contains("value", F.lit('"type":"assistant"'))
    return lines.agg(F.count_if(hit).alias("turns"))


def markdown_notes(notes: DataFrame) -> DataFrame:
    """(key, memory_type, title, value) of notes (path, text): the head between dashes names them, the rest is the value."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    parts = F.split("text", r"(?m)^---\s*$", 3)
    has = F.startswith("text", F.lit("---")) & (F.size(parts) == 3)
    head = F.when(has, parts[1]).otherwise(F.lit(""))
    field = lambda *names: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^(?:{'|'.join(names)})\s*:\s*(.+)$", 1)), F.lit(""))
    rows = notes.where(F.endswith("path", F.lit(".md")) & ~F.upper(stem).isin(*SKIPPED_NOTES))
    return rows.select(F.coalesce(field("name", "slug"), stem).alias("key"), field("type", "memory_type").alias("memory_type"), field("description", "title").alias("title"), F.regexp_replace(F.when(has, parts[2]).otherwise(F.col("text")), r"^\s+|\s+$", "").alias("value"))


def distilled_facts(reply: str) -> list[dict[str, Any]]:
    """The facts of a reply: the JSON list between its first and last bracket; a fact without key or value is an error."""
    a, b = reply.find("["), reply.rfind("]")
    if a < 0 or b < a:
        raise ValueError("no list in the reply")
    out = []
    for x in json.loads(reply[a : b + 1]):
        if not isinstance(x, dict) or not isinstance(x.get("key"), str) or not isinstance(x.get("value"), str):
            raise ValueError(f"a fact without key or value: {x!r}")
        text = {k: v if isinstance(v, str) else None for k, v in x.items()}
        project = x.get("project")
        if isinstance(project, str):
            m = re.fullmatch(r"#*(-?\d+)", project.strip())
            project = int(m[1]) if m else None
        elif isinstance(project, bool) or not isinstance(project, int):
            project = None
        kind = text.get("type")
        if x["key"] and x["value"]:  # an empty one is no error, and no fact
            out.append({
                "key": x["key"], "value": x["value"], "type": "project" if kind is None else kind, "supersedes": (text.get("supersedes") or "").strip() or None,
                "repo_scope": (text.get("scope") or "").strip().lower() == "repo", "project": project,
            })
    return out
