"""Turns, splitting, encoding, leaks and residue on small texts."""

import random
import re

import pytest

from tarnstone.llm import encode, leaks, residue, split, turns

PEOPLE = [(1, "Ada Maria Brontefield", "host"), (2, "Cyril Dunmorrow-Eastgate", None), (3, "Edward Farnsgate", "Presenter ")]


@pytest.mark.parametrize("text,want", [
    ("WEBVTT\n\n1\n00:00:09.000 --> 00:00:10.000\n<v Ada>Second.</v>\n\n2\n00:00:01.000 --> 00:00:02.000\n<v CD>First [noise] one.</v>\n\n3\n00:00:03.000 --> 00:00:04.000\n<v Ada>um, uh.</v>\n\n4\n00:00:05.000 --> 00:00:06.000\nDunmorrow-Eastgate, Cyril: still\nme\n", [2, 1]),
    ('{"start": 5.5, "speaker": "Eddie", "text": "b"}\n{"start": 1.0, "speaker": "ADA BRONTEFIELD", "text": "a"}\n{"start": 2.0, "speaker": null, "text": "[door closes]"}', [1, 3]),
    ("Ada  0:01:00\nHello\nthere.\n\r\nPresenter  0:02:00\nNow me: really.\n", [1, 3]),
    ("[0:00:10] Ada: one\n  more\n[0:00:12] [MUSIC]\n[0:00:14] Ada (host): two\n[0:00:20] Ted: three", [1, 3]),
    ("CD (00:10): one\r\nEF (00:05): two\r\n(00:12) [laughter]\r\nCD (00:15): three", [3, 2]),
    ("Ada - one - er - two\nCyril - three\nada brontefield - four", [1, 2, 1]),
    (">> Ada: one\n>> Action item: not a speaker\n>> Cyril: two", [1, 2]),
    ("Speakers: Speaker 2 = Ada Brontefield, Speaker 1 = Edward Farnsgate\nSpeaker 1: x\nSpeaker 2: y\nSpeaker 1: hmm...\nSpeaker 2: z", [3, 1]),
    ("Just prose without any speaker. It goes on.", []), ("", []), ("   ", []),
])
def test_turns(text, want):
    assert [p for p, _, _ in turns.turns(text, PEOPLE)] == want


def test_clean_and_overlap():
    assert turns.clean("Um, I, you know, think - er - we [inaudible] should *coughs* go.") == "I, think we should go."
    assert turns.clean("uhm uhm...") == "" and turns.clean("♪♪") == "" and turns.clean("(phone rings)") == ""
    assert turns.overlap("we should move the call", "the call graph now") == 8
    assert turns.overlap("abc", "xyz") == 0


def test_rolling_captions_and_pauses():
    text = "\n".join(f"[0:{m:02d}:{s:02d}] Ada: {t}" for m, s, t in [(0, 0, "we move the call"), (0, 2, "the call graph now"), (0, 4, "and then"), (0, 6, "we stop"), (9, 0, "again")])
    assert [t for _, _, t in turns.turns(text, PEOPLE)] == ["we move the call graph now and then we stop again"]
    assert [t for _, _, t in turns.turns(text, PEOPLE, pauses=True)] == ["we move the call graph now and then we stop", "again"]


def test_silence_is_measured_from_the_last_end():
    cue = lambda a, b, t: f"00:{a:02d}:00.000 --> 00:{b:02d}:00.000\nAda: {t}\n"
    text = "WEBVTT\n\n" + "\n".join([cue(0, 1, "one"), cue(1, 30, "a long one"), cue(2, 3, "over it"), cue(30, 31, "right after"), cue(31, 32, "more"), cue(33, 34, "and"), cue(55, 56, "late")])
    assert [t for _, _, t in turns.turns(text, PEOPLE, pauses=True)] == ["one a long one over it right after more and", "late"]
    assert len(turns.turns(text, PEOPLE)) == 1


def test_long_notes_and_labels():
    note = "[" + "the door of the northern room opens and closes again " * 3 + "]"
    assert turns.clean(note) == "" and turns.clean("♪ la la ♪ we start") == "we start" and turns.clean("about ♪♪ the plan ♪♪ of May") == "about the plan of May"
    label = "Ada Maria Brontefield (" + "team of the northern room and its doors " * 3 + ")"
    assert [p for p, _, _ in turns.turns(f"{label}: one\nCyril: two\n{note}\nCyril: three", PEOPLE)] == [1, 2]
    assert turns.turns("We asked what Ada and then Brontefield wanted from us all: nothing", PEOPLE) == []


def test_turns_frame(spark):
    m = spark.createDataFrame([(1, "Ada: hi", "x"), (2, None, "x"), (3, "Ada: x", "x"), (4, "", "x")], "id long, transcript string, people string")
    mp = spark.createDataFrame([(1, 1, "host"), (1, 1, "guest"), (1, None, None), (None, 1, None), (2, 1, None), (4, 1, None)], "meeting_id long, person_id long, role string")
    p = spark.createDataFrame([(1, "Ada Brontefield", "r")], "id long, name string, role string")
    assert [(r.meeting_id, r.turn_no, r.person_id, r.text) for r in turns.speaker_turns(m, mp, p).collect()] == [(1, 1, 1, "hi")]
    assert turns.speaker_turns(m.limit(0), mp, p).count() == 0


def test_blank_and_carriage_returns():
    assert split.split(" \n" * 900) == [(0, 800, False), (800, 1600, False), (1600, 1800, False)]
    text = "\r".join(f"line {k} " + "x" * 90 for k in range(40))
    pieces = split.split(text, lines=3)
    assert all(text[a - 1] == "\r" for a, _, _ in pieces[1:]) and any(b[0] < a[1] for a, b in zip(pieces, pieces[1:]))
    places = [a for a, _, _ in pieces]
    assert split.lines_before(text, places) == [len(re.findall(r"\r\n|\n|\r", text[:a])) for a in places]


def _texts():
    rng = random.Random(4)
    gaps = [" ", " ", " ", "\n", "\n\n", "\r\n", "\t", ". ", "  "]
    for n in (1, 40, 300, 900):
        yield "".join("é" * rng.randrange(1, 14) + rng.choice(gaps) for _ in range(n))
    yield "a" * 800 + " " + "b" * 800
    yield "a" * 801
    yield "x " + "y" * 2500 + " z"
    yield " \n " * 900
    yield "w " * 3000
    yield ("a" * 799 + " ") * 5
    yield "\n".join(f"line {k}" * rng.randrange(1, 9) for k in range(400))


@pytest.mark.parametrize("lines", [None, 3])
def test_split(lines):
    for text in _texts():
        pieces = split.split(text, lines=lines)
        end = 0
        for a, b, _ in pieces:
            assert b - a <= 800 and b > end or not text.strip()
            assert not text[end:a].strip(" \t\r\n")
            assert a >= end - 200 or lines
            end = b
        if text.strip():
            assert not text[end:].strip(" \t\r\n")
            if len(text) > 800:
                assert any(f for _, _, f in pieces) == (max(map(len, re.split("[ \t\r\n]", text))) > 800)


def test_valley_is_a_topic_boundary():
    a, b = "apple pear plum cherry. " * 24, "engine wheel brake motor. " * 30  # the change lies in the window's second half
    assert abs(split.split(a + b)[0][1] - len(a)) <= 26


def test_split_frame(spark):
    m = spark.createDataFrame([(1, "w " * 900), (2, None), (3, "short")], "id long, transcript string")
    c = spark.createDataFrame([(1, "x\r\n" * 600, 10, "q"), (2, "y" * 900, None, "q"), (3, "", 1, "q")], "id long, chunk_text string, start_line long, text string")
    rows = split.split_items(m, c).collect()
    kinds = {(r.item_kind, r.item_id, r.cut_kind) for r in split.cut_kinds(split.split_items(m, c)).collect()}
    assert kinds == {("meeting", 1, "natural"), ("chunk", 1, "natural"), ("chunk", 2, "forced")}
    first = sorted((r.char_start, r.start_line) for r in rows if (r.item_kind, r.item_id) == ("chunk", 1))
    assert first[0] == (0, 10) and all(line == 10 + at // 3 for at, line in first)
    assert all(r.start_line is None for r in rows if (r.item_kind, r.item_id) != ("chunk", 1))
    assert split.cut_kinds(split.split_items(m.limit(0), c.limit(0))).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encode.read_ranks(path), special_tokens={})


def test_encode_equals_tokenizer(vocabulary):
    path, pattern, own = vocabulary
    rng, enc = random.Random(6), encode.encoder(path, pattern)
    pool = "abcdefghij ABC 0123456789 \n\t'.,é東京🚀שa​<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["a" * 3000, "ab" * 2000, "0" * 999, "<|endoftext|>", "I'll we've DON'T", "   x", "東" * 700]
    assert [enc(t) for t in texts] == [own.encode_ordinary(t) for t in texts]
    assert enc(None) == [] and enc("") == []


def test_encode_frame(spark, vocabulary):
    path, pattern, own = vocabulary
    df = spark.createDataFrame([(1, "hello", [9]), (2, None, [9]), (3, "", [9]), (3, "", [9])], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, list(r.ids)) for r in encode.encode_corpus(df, path, pattern).collect())
    assert got == [(1, own.encode_ordinary("hello")), (2, []), (3, []), (3, [])]
    assert encode.encode_corpus(df.limit(0), path, pattern).count() == 0


ITEM = "Which of the five quiet sketches by Dalia shows the cold engine with exactly 22 teeth on it?"


@pytest.mark.parametrize("limit", [leaks.BLOCK_BYTES, 40])
def test_leaks(spark, limit):
    docs = [
        (1, "before " + ITEM + " after"), (2, "WHICH OF THE FIVE <em>QUIET</em> SKETCHES, by Da​lia shóws **the** cold engine"),
        (3, "which of the five quiet sketches by dalia shows the cold"), (4, "> Which of the five \n> quiet sketches by Dalia \n> shows the cold engine"),
        (5, "a short one here and gone"), (6, "short one"), (7, None), (8, ""), (9, ("filler " * 9000) + ITEM),
    ]
    items = [(10, ITEM), (11, "Short one here?"), (12, None), (13, "..."), (14, ITEM)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, i, block_bytes=limit).collect()}
    assert got == {(k, n) for k in (1, 2, 4, 9) for n in (10, 14)} | {(5, 11)}


def test_spans_are_the_same_for_any_blocks(spark):
    words = [f"w{k}" for k in range(60)]
    d = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[20:] + words[:14])), (2, "x")], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20] * 2)), (3, "w7 w8")], "item_id long, text string")
    want = {(1, 1, 0, 30), (1, 2, 0, 20), (1, 3, 7, 9), (2, 1, 0, 54), (2, 2, 40, 54), (2, 3, 47, 49)}
    for limit in (leaks.BLOCK_BYTES, 100):
        assert {tuple(r) for r in leaks.leak_spans(d, i, block_bytes=limit).collect()} == want


def test_leaks_under_markup():
    assert leaks.words_of("two<br>three <p class='x'>four</p>five w<b>or</b>d") == ["two", "three", "four", "five", "word"]
    assert leaks.words_of(f'one <a href="{"x" * 900}" title=y>two</a>') == ["one", "two"]
    assert leaks.words_of("if a <b and so on " + "word " * 3) == ["if", "a", "b", "and", "so", "on", "word", "word", "word"]
    assert leaks.words_of(f"[link](http://{'y' * 900}.example) ok") == ["link", "ok"]
    assert leaks.words_of("東京 abc") == ["東", "京", "abc"]


def test_leak_windows_by_brute_force():
    rng = random.Random(3)
    word = lambda: rng.choice("abcd")
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 9)))) for k in range(30)]
    index = leaks.Index(items, 5)
    for _ in range(50):
        words = [word() for _ in range(rng.randrange(40))]
        runs = {(k, a) for k, t in items for r in leaks.runs_of(t.split(), 5) for a in range(len(words)) if tuple(words[a : a + len(r)]) == r}
        got = index.hits(words, leaks.Windows(), {})
        assert {k for k, _ in runs} == {k for k, _, _ in got}
        assert all(any(i == k and a <= x < b for i, a, b in got) for k, x in runs)


def test_leak_removal(spark):
    d = spark.createDataFrame([(1, ITEM, 1), (2, "fine", 1), (3, None, 1)], "doc_id long, text string, _leaked int")
    i = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r.doc_id for r in leaks.without_leaks(d, i).collect()) == [2, 3]
    assert leaks.leaks(d, i.limit(0)).count() == 0 and leaks.leaks(d.limit(0), i).count() == 0


BAD = [
    "# {{title}}\n\n- [NAME]", "The pier %TEAM_NAME% was moved", "Lorem ipsum dolor sit", "404 Not Found\n\nHome | Notes | Sign in", "Please enable JavaScript to run this app.",
    "<noscript>Active JavaScript para continuar.</noscript>", '{"error":{"code":8,"message":"upstream request timeout"}}', "Seite nicht gefunden.", "asdf asdf qwer", "Oops! Something went wrong on our side.",
    "Dear __SERVICE_NAME__ team", "`{{first_name}}`",
]
GOOD = [
    "A test asserts that the text `{{first_name}}` never reaches the mail.", 'We alert when the body holds "404 Not Found" more than 3 times.', "Users saw the words 'Please enable JavaScript to run this app' twice.",
    "Write `[NAME]` in the header.", "We moved the error budget and the release script on page 404 of the book.", "- [ ] Remember to rename {x for x in y}", "a [link](http://x.example) and [1]", "", None, "été naïve",
]


def test_residue(spark):
    rows = [(k, t, None, None, 1) for k, t in enumerate(BAD)] + [(100 + k, t, "title", "a/b", 1) for k, t in enumerate(GOOD)] + [(500, "word " * 50000 + "${owner}", "t", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, source string, bone int")
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == [*range(len(BAD)), 500]
    assert residue.residue(df.limit(0)).count() == 0


def test_residue_by_shared_response(spark):
    rows = [(k, f"Request {k} ended with error {k}", f"Harbor plan {k % 7}", f"host{k % 3}/notes") for k in range(12)] + [(99, "Harbor error", "Harbor", "host1/notes")]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, source string")
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == list(range(12))
