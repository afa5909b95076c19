"""Places over all rows, stems without an index, supersession, histories, vectors in blocks."""

import random

import numpy as np
import pytest

from tarnstone.functions import text as X
from tarnstone.operators import changes as C
from tarnstone.operators import ordering as O
from tarnstone.plans import embedding as EM
from tarnstone.plans import fulltext as FT
from tarnstone.plans import symbols as S
from tarnstone.plans import vectors as V
from tarnstone.sources import readers as R


@pytest.mark.parametrize("one_task", [10_000, 3])
def test_numbered(spark, one_task):
    rng = random.Random(1)
    rows = [(k, rng.choice("abc"), rng.randrange(50)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(5)
    got = {r.id: r.place for r in O.numbered(df, "v", "id", one_task=one_task).collect()}
    assert got == {i: n for n, (v, i) in enumerate(sorted((v, i) for i, _, v in rows), 1)}
    by = {r.id: r.place for r in O.numbered(df, "v", "id", by="g", one_task=one_task).collect()}
    assert by == {i: n for g in "abc" for n, (v, i) in enumerate(sorted((v, i) for i, x, v in rows if x == g), 1)}
    assert O.numbered(df.limit(0), "v", one_task=one_task).count() == 0


def test_stems_without_an_index_equal_the_index(spark):
    texts = ["renaming the QueueReader now", "Renamed queues, renames", "a queue; the résumé of it", "", None, "dequeue rename", "re-naming", "the Requeue job renames RequeueJob", "résumés renamed " * 40]
    df = spark.createDataFrame([(k, t, "queue" if k == 3 else None) for k, t in enumerate(texts)], "id long, body string, title string")
    source = FT.Source("id", {"body": 1.0, "title": 4.0})
    for query in ("renaming queues", "resume", "queue-reader", "rename", "zzz"):
        strict = FT.phrases(X.sanitize(query), True)
        index = FT.postings(df, source, stems=True)
        want = {r.doc: round(r.score, 9) for r in FT.bm25(index, df, strict, source.weights).collect()}
        got = {r.doc: round(r.strict, 9) for r in FT.stem_hits([("", df, source, None)], query, strict, []).where("strict IS NOT NULL").collect()}
        assert got == want, query


def test_kinds_have_statistics_and_places_of_their_own(spark):
    df = spark.createDataFrame([(k, "ferry times" if k % 2 else "harbour") for k in range(20)], "id long, t string")
    source = FT.Source("id", {"t": 1.0})
    both = FT.search_all([("a", df, source, None), ("b", df.where("id < 5"), source, None)], "ferry")
    one = {(r.doc, r.tier, r.place, r.score) for r in FT.search(df.where("id < 5"), source, "ferry", stems=True).collect()}
    assert {(r.doc, r.tier, r.place, r.score) for r in both.where("type = 'b'").collect()} == one
    assert both.where("type = 'a'").count() == 10 and FT.search_all([("a", df, source, None)], " ").count() == 0


def test_supersede_into(spark):
    active = spark.createDataFrame([(1, "a", "va", "session"), (2, "b", "vb", "session"), (3, "m", "vm", "manual")], "id long, key string, value string, source string")
    given = spark.createDataFrame([("a", "b", "new"), ("b", "m", "x"), ("z", "b", "x"), ("b", "b", "x"), ("b", "fresh", "first")], "old_key string, new_key string, new_value string")
    got = {tuple(r) for r in C.supersede_into(active, given).collect()}
    assert got == {("retired", "a", "va"), ("retired", "b", "vb"), ("updated", "b", "new"), ("snapshot", "b", "vb"), ("added", "fresh", "first")}
    assert C.supersede_into(active.limit(0), given).count() == 0


def test_transitions_and_identifiers(spark):
    rows = spark.createDataFrame([(1, "open", "end"), (2, "ended", "end"), (3, None, "end")], "id int, status string, verb string")
    assert {tuple(r) for r in C.transitions(rows, "status", "verb", {("open", "end"): "ended"}).select("id", "status", "moved").collect()} == {(1, "ended", True), (2, "ended", False), (3, None, False)}
    given = spark.createDataFrame([(1, "mail", "x"), (2, "mail", "x"), (3, "fax", "y")], "id int, type string, value string")
    assert [r.state for r in C.identifiers(given, ["mail"], "id").orderBy("id").collect()] == ["ok", "taken", "unknown type"]


def test_histories(spark):
    lines = ["commit ab 30", "src/x.py", "", "commit aa 20", "src/x.py", "src/y.py", "commit a0 20", "z"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "repo int, n int, line string")
    assert {(r.path, r["at"]) for r in R.commit_dates(df, ["repo"], ["n"]).collect()} == {("src/x.py", 30), ("src/y.py", 20), ("z", 20)}
    assert [(r.hash, r["at"]) for r in R.oldest_commit(df, ["repo"], ["n"]).collect()] == [("a0", 20)]
    states = spark.createDataFrame([("A\tx",), ("M\ty",), ("R100\told\tnew",), ("C75\ta\tb",)], "line string")
    assert {tuple(r) for r in R.name_status(states, "line").collect()} == {("x", "A"), ("y", "M"), ("old", "D"), ("new", "A"), ("b", "A")}


def test_overlaps_equal_the_plain_rule(spark):
    rng = random.Random(5)
    rows = [(k, "f", a := rng.randrange(300), a + rng.randrange(20), rng.randrange(9) / 3) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, f string, a long, b long, score double")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if all(r[3] < k[2] or r[2] > k[3] for k in kept):
            kept.append(r)
    assert {r.id for r in V.without_overlaps(df, ["f"], "a", "b", "id").collect()} == {r[0] for r in kept}


@pytest.mark.parametrize("block", [4096, 2])
def test_vectors_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 4)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<float>")
    got = {(r.query_key, r.id) for r in V.nearest_records(df, df.where("id < 7"), "vec", "id", 3, block).collect()}
    s = V.cosine(x.astype(float), x.astype(float)) - 9 * np.eye(40)
    assert got == {(q, int(i)) for q in range(7) for i in np.argsort(-s[q])[:3]}
    keys = spark.createDataFrame([(f"k{k % 10}", v.tolist()) for k, v in enumerate(x)], "key string, vec array<float>")
    probes = spark.createDataFrame([(k // 2, v.tolist()) for k, v in enumerate(x[:6])], "id long, vec array<float>")
    full = V.cosine(x[:6].astype(float), x.astype(float))
    best = {(a, f"k{k}"): max(full[p, r] for p in (2 * a, 2 * a + 1) for r in range(k, 40, 10)) for a in range(3) for k in range(10)}
    want = {(a, key) for a in range(3) for key in sorted((f"k{k}" for k in range(10)), key=lambda z: -best[a, z])[:4]}
    assert {(r.id, r.key) for r in V.best_keys(keys, probes, "key", "id", "vec", 4, block).collect()} == want


def test_embedder_and_bytes(spark):
    df = spark.createDataFrame([(1, "abba"), (2, " "), (3, None), (4, "zzz")], "id long, t string")
    got = {r.id: [round(v, 3) for v in r.vec] for r in EM.embedded(df, "id", "t", EM.Embedder(EM.letters, "p: ")).collect()}
    assert set(got) == {1, 4} and got[1][:2] == [0.707, 0.707] and sum(got[4]) == 0
    v = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None)], "id long, vec array<float>")
    raw = EM.packed_floats(v, "id", "vec")
    assert {r.id: list(r.vec) for r in EM.unpacked_floats(raw, "id", "raw").collect()} == {1: [1.5, -2.0], 2: []}


def test_symbols_and_calls(spark):
    code = "pub fn load_times(x: u8) {\n    parse_row(x);\n    if ready(x) { load_times(x) }\n}\nfn parse_row(y: u8) {\n    other.trim_end(y)\n}\n"
    df = spark.createDataFrame([(1, 1, "a.rs", None, code), (2, 1, "b.md", None, code), (3, 1, "c.rs", None, None)], "id long, repo_id long, file_path string, last_modified timestamp_ntz, chunk_text string")
    assert {(r.name, r.n, r.signature) for r in S.symbols(df).collect()} == {("load_times", 1, "pub fn load_times(x: u8)"), ("parse_row", 5, "fn parse_row(y: u8)")}
    calls = S.calls(df)
    assert {(r.caller, r.to_name) for r in calls.collect()} == {("load_times", "parse_row"), ("load_times", "ready"), ("load_times", "load_times"), ("parse_row", "trim_end")}
    graph = {(r.name, r.depth, r.known) for r in S.graph_of_names(calls, S.symbols(df), "load_times", 5).collect()}
    assert graph == {("load_times", 0, True), ("parse_row", 1, True), ("ready", 1, False), ("trim_end", 2, False)}


def test_range_and_settings(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, 5000), (3, 10), (4, 700)], "id int, flag int")
    assert [r.x for r in df.select(R.setting([F.col("flag")], 800, 200, 4000).alias("x")).collect()] == [800, 4000, 200, 700]


def test_language_needs_an_extension(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("src/go",), ("sql",), ("a.go",), ("b.tar.py",), (".md",), ("x.zz",), (None,)], "path string")
    assert [r.x for r in df.select(R.language(F.col("path")).alias("x")).collect()] == [None, None, "go", "python", "markdown", None, None]
