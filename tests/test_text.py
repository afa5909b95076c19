"""Text functions against cases worked out by hand."""

import datetime as dt

import pytest

from tarnstone.functions import dates as D
from tarnstone.functions import text as X
from tarnstone.functions.maths import split_mix
from tarnstone.sources import readers as R


def test_query_terms():
    assert X.sanitize('night-shift rota "harbour"gate') == ["night-shift", "rota", "harbourgate"]
    assert X.loose_terms("when did the ferry leave Oslo?") == ["ferry", "leave", "Oslo?"]
    assert X.loose_terms("who are") == ["who", "are"]
    assert X.loose_terms("ferry") is None and X.loose_terms("! ;") is None
    assert X.code_terms("Where do we log ferry times? see load_times()") == ["log", "ferry", "times", "see", "load_times"]
    assert X.code_terms("ferry") == []
    assert X.trigram_terms("go harbour") == ["harbour"] and X.trigram_terms("go by") == []


@pytest.mark.parametrize("word,parts", [("XMLReader", ["XML", "Reader"]), ("base64Text", ["base64", "Text"]), ("HarbourGT", ["Harbour", "GT"]), ("setQ", ["set"]), ("lane4", [])])
def test_word_parts(word, parts):
    assert X.word_parts(word) == parts


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalizations", "gener"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("splits", "split")])
def test_stem(word, stem):
    assert X.stem(word) == stem


def test_tokens_share_positions():
    found = X.tokens("the new HarbourReports.")
    assert [t for t in found if t[0] == 2] == [(2, "harbourreport", False), (2, "harbour", True), (2, "report", True)]


def test_chunk_text():
    assert X.chunk_text("a\nbb cc dd ee ff", 12, 0) == ["a\nbb cc dd", "ee ff"]
    assert X.chunk_text(" \n\nabcdefgh", 5, 0) == ["abcde", "fgh"]
    assert [len(c) for c in X.chunk_text("x" * 2500, 1000, 0)] == [1000, 1000, 500]
    parts = X.chunk_text("\n\n".join(f"paragraph {k} " + "w " * 30 for k in range(40)), 300, 60)
    assert all(len(p) <= 300 for p in parts) and len(parts) > 5


def test_chunk_text_by_hand():
    assert X.split_long("aa bbb cccc", 6) == ["aa", "bbb", "cccc"]  # the window is the first six characters
    assert X.split_long(" lead", 9) == [" lead"] and X.split_long("abcdefgh ij", 4) == ["abcd", "efgh", "ij"]
    assert X.chunk_text("  \n ", 10, 2) == ["  \n "] and X.chunk_text("", 10, 2) == [""]
    assert X.chunk_text("first part\n\nsecond part\n\nthird", 20, 6) == ["first part", "...part\n\nsecond part", "...d part\n\nthird"]
    assert X.overlap_tail("harbour", 10, 10) == "harbour" and X.overlap_tail("harbour", 10, 6) == "...our" and X.overlap_tail("harbour", 4, 20) == "...bour"
    assert X.overlap_tail("harbour", 4, 3) == "" and X.overlap_tail("harbour", 0, 9) == ""


def test_split_code_keeps_every_line():
    text = "\n".join(f"line {k} " + "x" * (k % 37) for k in range(200))
    pieces = X.split_code(text, 300)
    assert {n for a, b, _ in pieces for n in range(a, b + 1)} == set(range(200))
    assert all(len(t.encode()) <= 300 for _, _, t in pieces)
    assert X.split_code("y" * 999 + "\nz", 100)[0][:2] == (0, 0)


def test_remotes():
    same = {X.normal_remote(u) for u in ("git@host.example:Own/repo.git", "https://Host.example/Own/repo", "ssh://git@host.example:22/Own/repo.git", "git://host.example/Own/repo")}
    assert same == {"host.example/Own/repo"}
    assert X.normal_remote("/home/x") is None and X.normal_remote("C:\\x") is None and X.normal_remote("file:///x") is None


def test_bytes_and_quotes():
    assert X.truncate_bytes("héllo", 2) == "h..." and X.truncate_bytes("a" * 119 + "é", 120) == "a" * 119 + "..."
    assert X.yaml_quote('a"b\n\x01') == '"a\\"b\\n\\x01"'
    assert X.terminal_safe("a\tb\x1b") == "a b\\u{1b}"


def test_dates():
    today = dt.date(2026, 3, 31)
    assert D.bound("1m", today, False) == "2026-02-28 00:00:00"
    assert D.bound("2w", today, True) == "2026-03-17 23:59:59"
    assert D.range_of("2026-06-01T09:30", "2026-06-01 10:00", today) == ("2026-06-01 09:30:00", "2026-06-01 10:00:59")
    with pytest.raises(ValueError):
        D.range_of("2026-06-02", "2026-06-01", today)
    with pytest.raises(ValueError):
        D.bound("soon", today, True)


def test_split_mix_known_values():
    assert split_mix(0, 3) == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]


def test_facts():
    facts = R.distilled_facts('sure: [{"key": "a", "value": "b", "scope": "REPO", "project": "#12", "supersedes": " "}] done')
    assert facts == [{"key": "a", "value": "b", "type": "project", "supersedes": None, "repo_scope": True, "project": 12}]
    with pytest.raises(ValueError):
        R.distilled_facts('[{"key": "a"}]')
    assert R.distilled_facts('[{"key": "", "value": "b"}]') == []
    assert R.distilled_facts('[{"key": "a", "value": "b", "scope": " repo ", "project": "x", "type": 5}]')[0] == {"key": "a", "value": "b", "type": "project", "supersedes": None, "repo_scope": True, "project": None}


def test_eval_files():
    good = "[[query]]\nid = 1\nkind = 'k'\ntext = 'where'\nrelevant = [1]\n"
    assert R.parsed_queries(good) == [{"id": 1, "kind": "k", "text": "where", "relevant": [1]}]
    for bad in (good + good, good.replace("kind", "sort"), good.replace("id = 1", "id = 'x'"), good.replace("'where'", "' '"), "top = 1\n"):
        with pytest.raises(ValueError):
            R.parsed_queries(bad)


def test_wordpiece():
    from tarnstone.functions.wordpiece import count_tokens, pieces

    known = {"har", "##bour", "##s", "gate", "a"}
    assert pieces("harbours", known) == ["har", "##bour", "##s"] and pieces("xyz", known) is None and pieces("a" * 101, known) is None
    assert count_tokens("Harbours, gäte xyz 東京", known) == 3 + 1 + 1 + 1 + 2
    assert count_tokens("", known) == 0 and count_tokens(None, known) is None and count_tokens("abcde", None) == 2


def test_python_symbols():
    src = "class A:\n    def f(self):\n        return g(h.i(1))\n"
    assert R.python_symbols(src) == [("class", "A", 1, 3), ("function", "f", 2, 3)]
    assert R.python_calls(src) == [("f", "g"), ("f", "i")]
    assert R.python_symbols("def (") == []
