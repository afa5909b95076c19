"""Names, survivors, components and near-duplicates against brute force and on awkward input."""

import random
import re

import numpy as np
import pytest

from tarnstone.llm import components, names, near, truth

PEOPLE = "id long, name string, email string, github_username string, sig string, org int"
MEMORY = "id long, key string, value string, status string, source string, superseded_by long, updated_at string, tags string, reviewed_at timestamp_ntz, grp string, w int"


def _people(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PEOPLE)


def _linked(df):
    return sorted((r.lo_id, r.hi_id) for r in names.variant_pairs(df).collect())


def test_variants_are_linked(spark):
    df = _people(spark, [
        (1, "Margaret Hollinbeck", "margaret.hollinbeck@one.example", "mhollin"),
        (2, "HOLLINBECK Margaret", None, "https://host.example/MHOLLIN"),
        (3, "Hollinbeck, Meg", "mailto:margaret.hollinbeck+x@one.example", "n/a"),
        (4, "Margaret Holinbeck", None, None),
        (5, "Edward Hollinbeck", "e.hollinbeck@one.example", None),
        (6, "Drathowic & Sons Freight Ltd.", "info@drathowic.example", None),
        (7, "The Drathowic and Sons Freight", "sales@drathowic.example", None),
        (8, None, None, None), (9, "", " ", "?"), (10, "x" * 5000, "unknown", "ghost"),
    ])
    assert _linked(df) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)]


def test_namesakes_stay_apart(spark):
    df = _people(spark, [
        (1, "Vera Lakifering", "vera.lakifering12@one.example", "vlaki"), (2, "Vera Lakifering", "lakiferingve77@two.example", "ve-laki-9"),
        (3, "V. Lakifering", None, "vlaki"), (4, "Vera Lakifering", None, "ve-laki-9"),
    ])
    assert _linked(df) == [(1, 3), (2, 4)]


def test_shared_contacts_identify_nobody(spark):
    rows = [(k, n, "team@lists.example", None) for k, n in enumerate(["Ada Brontefield", "Cyr Dunmorrow", "Eli Farnsgate", "Gil Harroway"])]
    assert _linked(_people(spark, rows)) == []
    assert names.link_people(_people(spark, rows).limit(0)).count() == 0


def test_slips_make_no_strangers(spark):
    """A contact of one person stays one, however many beginnings of the surname are mistyped."""
    mail = "frieda_deltaruklin84@coppercairn.example"
    df = _people(spark, [
        (1, "Frieda Dteltaruklin", mail, None), (2, "Frieda Deltaruklin", mail, None), (3, "Frieda Drltaruklin", mail, None), (4, mail, None, None),
    ])
    assert _linked(df) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    rows = [(k, f"Vera {'Lakifering'[:k % 9]}q{'Lakifering'[k % 9:]}" if k % 3 == 0 else "Vera Lakifering", None, "vlaki") for k in range(90)] + [(100, None, None, "vlaki")]
    assert len({r.entity for r in names.link_people(_people(spark, rows)).collect()}) == 1


def test_parts_in_the_other_order(spark):
    df = _people(spark, [(1, "Vera Lakifering", None, None), (2, "Lakifering Vera", None, None), (3, "Lakiferin Vera", None, None), (4, "Lakifering Edward", None, None), (5, "Vera Brontefield", None, None)])
    assert _linked(df) == [(1, 2), (1, 3), (2, 3)]


def test_hot_block_is_spread(spark):
    rows = [(k, "Vera Lakifering", f"vera.lakifering{k}@one.example", f"h{k}") for k in range(60)] + [(100, "Vera Lakiferin", None, "h7")]
    found = {(r.id, r.entity) for r in names.link_people(_people(spark, rows), hot_rows=10).collect()}
    assert found == {(7, 7), (100, 7)}


def _ranked(rows):
    """Brute-force order of trust of TESTDATA's problem 2 on plain stamps."""
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1].strip().lower(), []).append(r)
    out = set()
    for key, g in groups.items():
        if len(g) < 2:
            continue
        ids = {r[0] for r in g}
        stat, src = ["active", "stale", "superseded"], ["manual", "imported", "distilled", "session", "claude-auto"]
        pos = lambda names, v: names.index(v) if v in names else len(names)
        form = lambda v: v.strip().lower() if v else v
        order = sorted(g, key=lambda r: (r[5] in ids and r[5] != r[0], pos(stat, form(r[3])), pos(src, form(r[4])), r[6] is None, "".join(chr(0x10FFFF - ord(c)) for c in r[6] or ""), -r[0]))
        out.add((key, "record", order[0][0]))
        for f, ok in (("value", lambda r: bool(r[2] and r[2].strip())), ("tags", lambda r: bool(r[7]) and r[7].startswith('["')), ("reviewed_at", lambda r: r[8] is not None)):
            hit = [r[0] for r in order if ok(r)]
            if hit:
                out.add((key, f, hit[0]))
    return out


def test_survivors_equal_brute_force(spark):
    import datetime as dt

    rng = random.Random(5)
    rows = []
    for i in range(400):
        rows.append((
            i, rng.choice([None, "a", " A ", "b", "B\n", "c", "hot", "Hot ", f"k{rng.randrange(90)}"]), rng.choice([None, "", "  ", "v1", "v2"]),
            rng.choice([None, "active", "ACTIVE ", "stale", "superseded", "odd"]), rng.choice([None, "manual", "Session", "claude-auto", "x"]),
            rng.choice([None, rng.randrange(400), i, 9999]), rng.choice([None, "2025-01-01 00:00:00", "2025-01-02 00:00:00"]),
            rng.choice([None, "[]", "", '["x"]', "[x"]), rng.choice([None, dt.datetime(2025, 1, 1)]), "g", 1,
        ))
    df = spark.createDataFrame(rows, MEMORY)
    assert {(r.memory_key, r.field, r.from_id) for r in truth.survivors(df).collect()} == _ranked(rows)
    assert truth.survivors(df.limit(0)).count() == 0
    assert truth.supported_values(df.limit(0)).count() == 0


def test_learned_reliability_outvotes_a_liar(spark):
    rows = []
    for k in range(40):
        rows += [(3 * k, f"k{k}", f"true {k}", "active", "session", None, None, None, None, "g", 1), (3 * k + 1, f"k{k}", f"true {k}", "active", "distilled", None, None, None, None, "g", 1), (3 * k + 2, f"k{k}", f"false {k}", "active", "manual", None, None, None, None, "g", 1)]
    got = {r.memory_key: r.from_id for r in truth.supported_values(spark.createDataFrame(rows, MEMORY)).where("field = 'value'").collect()}
    assert all(v % 3 != 2 for v in got.values()) and len(got) == 40


@pytest.mark.parametrize("text,micros", [("1747027897", 1747027897000000), ("2025-12-12T15:24:45+02:00", 1765545885000000), ("2025-04-18", 1744934400000000), ("2025-07-07 04:01", 1751860860000000), ("2026-02-15T21:17:58.320", 1771190278320000), ("yesterday", None), ("", None), (None, None), ("2025-13-45", None)])
def test_instants(spark, text, micros):
    assert spark.createDataFrame([(text,)], "t string").select(truth.instant("t")).first()[0] == micros


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("case", ["random", "chain", "star", "loops"])
def test_components(spark, case):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(600), rng.randrange(600)) for _ in range(450)],
        "chain": [(k, k + 1) for k in rng.sample(range(300), 300)],
        "star": [(1000, k) for k in range(400)] + [(k, 1000) for k in range(50)],
        "loops": [(5, 5), (5, 5), (7, 8), (8, 7)],
    }[case]
    df = spark.createDataFrame([(a, b, "x") for a, b in edges] + [(None, 1, "x"), (2, None, "x")], "u long, v long, row string")
    got = {r.vertex: r.component for r in components.connected_components(df, cell_edges=40, min_side=3).collect()}
    assert got == _components(edges)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_consolidate_rules(spark):
    m = spark.createDataFrame([(k,) for k in range(1, 9)], "id long")
    c = spark.createDataFrame([(1, 2, 0.7), (2, 1, 0.9), (2, 3, None), (4, 5, 0.69), (6, 6, 1.0), (7, 99, 1.0), (8, None, 1.0)], "memory_id long, matched_id long, score double")
    assert {(r.memory_id, r.group_id) for r in components.consolidate(m, c).collect()} == {(1, 1), (2, 1), (3, 1)}


def _similar(rows):
    sets = [(i, set(re.findall(r"[^\W_]+", f"{k or ''} {v}".lower()))) for i, k, v in rows if v is not None and v.strip()]
    return {(a, b) for a, x in sets for b, y in sets if a < b and x and y and 10 * len(x & y) >= 7 * len(x | y)}


def _near_rows():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(900)]
    rows = []
    for i in range(160):
        base = rng.sample(vocabulary, rng.randrange(1, 40))
        for _ in range(rng.randrange(1, 4)):
            words = [w for w in base if rng.random() > 0.1] + rng.sample(vocabulary, rng.randrange(3))
            rng.shuffle(words)
            rows.append((len(rows), rng.choice([None, "Key", ""]), " ".join(words)))
    return rows + [(5000, "k", None), (5001, "k", " \n"), (5002, "", "!!!"), (5003, "k", "w1 " * 4000), (5004, "K", "W1"), (5005, None, "w1 k")]


@pytest.mark.parametrize("cap,hot", [(128, 100_000), (2, 30)])
def test_near_pairs_equal_brute_force(spark, monkeypatch, cap, hot):
    monkeypatch.setattr(near, "CAP", cap)
    monkeypatch.setattr(near, "BATCH_ROWS", 500)
    rows = _near_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, key string, value string, sig int, cid string")
    monkeypatch.setattr(near.similar_classes, "__defaults__", (7, 10, hot))
    got = [(r.lo_id, r.hi_id) for r in near.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _similar(rows)


def test_near_empty(spark):
    df = spark.createDataFrame([], "id long, key string, value string")
    assert near.near_pairs(df).count() == 0 and near.near_groups(df).count() == 0


def test_near_long_and_frequent_words(spark):
    """Long sets need a number of signatures in proportion to their words; sets of frequent words only meet exactly."""
    rng = random.Random(8)
    code = np.full(1 << 16, 200, np.uint8)
    counts = [len(near.signatures(np.array([rng.getrandbits(62) for _ in range(n)], np.int64), code, 1 << 40)) for n in (40, 200, 1000, 4000)]
    assert counts[3] < 8 * counts[2] and counts[2] < 8 * counts[1] and counts[2] < 20_000
    common, rows = [f"c{k}" for k in range(7)], []
    for k in range(260):
        rows.append(" ".join(rng.sample(common, rng.randrange(1, 5))))
    for k in range(30):
        long = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 300))]
        rows += [" ".join(long), " ".join(long[rng.randrange(12) :] + ["extra"])]
    df = spark.createDataFrame([(k, None, v) for k, v in enumerate(rows)], "id long, key string, value string")
    sets = [set(v.split()) for v in rows]
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    for hot in (100_000, 20):
        members, classes = near.classes_of(df)
        links = {(r.lo, r.hi) for r in near.similar_classes(classes, hot_rows=hot).collect()}
        of = {r.id: r.cid for r in members.collect()}
        assert links == {tuple(sorted((of[a], of[b]))) for a, b in want if of[a] != of[b]}
    assert {(r.lo_id, r.hi_id) for r in near.near_pairs(df).collect()} == want


def test_all_pairs_of_a_large_group(spark):
    df = spark.createDataFrame([(k // 50, k) for k in range(120)], "sig long, cid long")
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if a // 50 == b // 50}
    got = [(r.x, r.y) for r in near.all_pairs(df, hot_rows=7).collect()]
    assert len(got) == len(want) and set(got) == want


def test_names_of_two_letters(spark):
    rows = [(1, "Wei Li"), (2, "Li, Wei"), (3, "Wei Lu"), (4, "Li Wei"), (5, "Xu"), (6, "Anna Ng"), (7, "ANNA NG"), (8, "Anna Ho")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id long, name string, email string, github_username string")
    assert {(r.lo_id, r.hi_id) for r in names.variant_pairs(df).collect()} == {(1, 2), (1, 4), (2, 4), (6, 7)}
