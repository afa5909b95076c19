"""Operators on small tables: searches in tiers, budgets, changes, graphs, streams, files."""

import pytest
from pyspark.sql import functions as F

from tarnstone.operators import changes as C
from tarnstone.operators import ordering as O
from tarnstone.operators import predicates as P
from tarnstone.plans import code as K
from tarnstone.plans import fulltext as FT
from tarnstone.plans import vectors as V
from tarnstone.sources import readers as R
from tarnstone.streaming import incremental as I

NOTES = FT.Source("id", {"title": 4.0, "body": 1.0})


def _notes(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, body string")


def test_every_term_first_and_once(spark):
    n = _notes(spark, [(1, "x", "alpha only"), (2, "x", "alpha and beta"), (3, None, None), (4, "", "")])
    found = FT.search(n, NOTES, "alpha beta").orderBy("tier", "place").collect()
    assert [(r.doc, r.tier) for r in found] == [(2, 0), (1, 2)]


def test_loose_cap(spark):
    n = _notes(spark, [(k, "x", "alpha") for k in range(30)])
    assert FT.search(n, NOTES, "alpha beta").count() == 10
    assert FT.search(n, NOTES, "alpha").count() == 30
    assert FT.search(n, NOTES, " ").count() == 0


def test_stems_and_parts(spark):
    n = _notes(spark, [(1, "x", "a change to FinancialDocument."), (2, "x", "splits everything")])
    hit = lambda q: [r.doc for r in FT.search(n, NOTES, q, stems=True, loose=False).where("tier = 0").collect()]
    assert hit("document") == [1] and hit("documents") == [1] and hit("financialdocument") == [1] and hit("split") == [2]
    assert hit("document parser") == []


def test_filter_leaves_scores(spark):
    n = _notes(spark, [(k, "x", "alpha " * (k + 1)) for k in range(5)])
    every = {r.doc: r.score for r in FT.search(n, NOTES, "alpha").collect()}
    some = {r.doc: r.score for r in FT.search(n, NOTES, "alpha", keep=F.col("id") > 2).collect()}
    assert some == {k: every[k] for k in (3, 4)}


def test_index_and_scan_agree(spark):
    n = _notes(spark, [(1, "retry Queue", "the queue retries the retry"), (2, "other", "queue"), (3, "x", "nothing here")])
    a = {r.doc: round(r.score, 9) for r in FT.bm25(FT.postings(n, NOTES), n, [["retr"], ["queue"]], NOTES.weights, every=False).collect()}
    b = {r.doc: round(r.score, 9) for r in FT.scan_bm25(n, NOTES, [["retr"], ["queue"]], every=False).collect()}
    assert a == b and set(a) == {1, 2}


def test_substring_is_literal(spark):
    n = _notes(spark, [(1, "", "cpu at 95 for an hour"), (2, "", "at 95% now")])
    assert [r.doc for r in FT.substring_hits(n, NOTES, "5%").collect()] == [2]
    assert FT.substring_hits(n, NOTES, "_").count() == 0


def test_budget_keeps_one(spark):
    m = spark.createDataFrame([(1, "a", "xxxx"), (2, "a", "xxxx"), (3, "a", "xxxx"), (4, "b", "x" * 99)], "id long, box string, body string")
    assert sorted(r.id for r in O.unread_budget(m, "box", 9).collect()) == [1, 2, 4]
    assert sorted(r.id for r in O.unread_budget(m, "box", 1).collect()) == [1, 4]


def test_date_range(spark):
    d = spark.createDataFrame([("2026-06-08 23:59:59.500",), ("2026-06-09",), ("soon",), (None,)], "t string")
    got = [r[0] for r in d.select(P.in_range(F.col("t"), "2026-06-01 00:00:00", "2026-06-08 23:59:59")).collect()]
    assert got == [True, False, False, False]
    assert d.where(P.in_range(F.col("t"), None, None)).count() == 4


def test_decision(spark):
    rows = [(False, 0, None, False, False), (False, 1, 0.96, False, False), (False, 1, 0.86, False, False), (False, 1, 0.99, True, False), (True, 0, None, False, False), (False, 1, 0.98, False, True)]
    d = spark.createDataFrame(rows, "declared boolean, n int, best double, manual boolean, reused boolean")
    act = C.decision(F.col("declared"), F.col("n"), F.col("best"), F.col("manual"), 0.95, F.col("reused"))
    assert [r[0] for r in d.select(act).collect()] == ["insert", "absorb", "flag", "flag", "supersede", "supersede match"]
    assert d.select(C.decision(F.col("declared"), F.col("n"), F.col("best"), F.col("manual"), None, F.col("reused"))).collect()[1][0] == "flag"


def test_upsert_and_snapshots(spark):
    active = spark.createDataFrame([("a", "1", "manual", "old", True), ("b", "2", "session", "old", True)], "key string, value string, source string, updated string, has_vector boolean")
    given = spark.createDataFrame([("a", "1", "session"), ("b", "3", "imported"), ("c", "4", "session")], "key string, value string, source string")
    after = {r.key: (r.value, r.source, r.updated, r.has_vector) for r in C.upsert(active, given, "key", "now").collect()}
    assert after == {"a": ("1", "manual", "old", True), "b": ("3", "imported", "now", False), "c": ("4", "session", "now", False)}
    again = C.upsert(active, given.where("key = 'a'"), "key", "now")
    assert C.snapshots(active, again, "key").count() == 0


def test_overlap_suppression(spark):
    c = spark.createDataFrame([(1, "f", 1, 9, 0.9), (2, "f", 5, 15, 0.8), (3, "f", 10, 12, 0.7), (4, "g", 1, 9, 0.1)], "id long, file string, a int, b int, score double")
    assert sorted(r.id for r in V.without_overlaps(c, ["file"], "a", "b", "id").collect()) == [1, 3, 4]


def test_vectors_without_direction(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (6, [1.0, 1.0])], "id long, v array<double>")
    got = {r.id: round(r.score, 3) for r in V.similar_to(v, v.where("id = 1"), "v").collect()}
    assert got == {1: 1.0, 6: 0.707}


def test_call_graph_and_supersession(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    assert {(r.node, r.depth) for r in K.call_graph(e, 1, 9).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert K.call_graph(e, 77, 3).count() == 0
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (4, 99), (5, 6), (6, 5), (7, None)], "id long, heir long")
    got = {(r.start, r.node) for r in K.supersession(rows, "id", "heir").collect()}
    assert got == {(k, k) for k in range(1, 8)} | {(1, 2), (1, 3), (2, 3), (5, 6), (6, 5)}


def test_line_search(spark):
    f = spark.createDataFrame([("f", "a widget\nno\nfrob only\nx\nfrob a widget\nfrob widget\n")], "path string, body string")
    assert [r.line_no for r in K.line_search(f, ["path"], "body", "frob widget").orderBy("place").collect()] == [6, 5]
    assert K.line_search(f, ["path"], "body", "fn").count() == 0


def test_changed_manifest(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", "9")], "p string, h string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "p string, h string")
    assert {(r.p, r.change) for r in I.changed(a, b, ["p"], "h").collect()} == {("y", "changed"), ("n", "added"), ("z", "removed")}


def test_files_are_admitted(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "src/c.txt").write_text("hello")
    (tmp_path / "src/big.rs").write_text("x" * 500)
    (tmp_path / "node_modules/d.js").write_text("x")
    got = R.admitted(R.files(spark, str(tmp_path)), 400)
    assert {(r.path.rpartition("/")[2], r.language) for r in got.collect()} == {("a.py", "python"), ("c.txt", "text"), ("big.rs", "text")}
    assert [(r.name, r.kind) for r in R.symbols(got).collect()] == [("f", "function")]


@pytest.mark.parametrize("parts", [1, 3])
def test_first_seen_once(spark, tmp_path, parts):
    folder = str(tmp_path / "s")
    df = spark.createDataFrame([(k % 5,) for k in range(40)], "k long").repartition(parts)
    df.write.parquet(folder)
    assert sorted(r.k for r in I.stream_first_seen(folder, df.schema, spark, "k").collect()) == [0, 1, 2, 3, 4]


def test_only_ascii_letters_fold(spark):
    n = _notes(spark, [(1, "", "5 K and É"), (2, "", "5 K and é"), (3, "", None)])
    assert [r.doc for r in FT.substring_hits(n, NOTES, "5 k").collect()] == [2]
    assert [r.doc for r in FT.substring_hits(n, NOTES, "É").collect()] == [1]
    assert [r.doc for r in FT.scan_bm25(n, NOTES, [["k"]]).collect()] == [2]
