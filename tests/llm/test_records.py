"""p1, p3, p4, p5, p6: records, against brute force and on edge cases."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import compare
from vacantia.llm import format_duplicates, gazetteer, history, names, queries, truth
from vacantia.llm.gazetteer import Gazetteer
from vacantia.llm.strings import osa


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, name, queries.QUERIES, queries.ORACLE)


# ---- p1 ----


def test_format_duplicates_edge_cases(spark):
    long = "x" * 50_000
    rows = [
        ("t", 1, "A-b", "C d", 0), ("t", 2, "c​D", "aB", 0), ("t", 3, None, "ab", 0), ("t", 4, " ", "ab", 0), ("t", 5, long, "y", 0), ("t", 6, long.upper(), "Y!", 0),
        ("t", 7, "a", "bcd", 0), ("u", 8, "A-b", "C d", 0), ("t", 9, "ab", "c d e", 0), ("t", 2, "c​D", "aB", 0), ("u", 10, "", "ab", 0), ("u", 11, "AB", None, 0),
    ]
    df = spark.createDataFrame(rows, "grp string, id bigint, a string, b string, n int")
    enc = format_duplicates.encode(df, "grp", "id", "a", "b", one_is_enough=("u",))
    got = sorted(map(tuple, format_duplicates.copies(enc).collect()))
    assert got == [("t", 1, 2), ("t", 5, 6), ("u", 10, 11)]
    empty = format_duplicates.encode(df.limit(0), "grp", "id", "a", "b")
    assert format_duplicates.copies(empty).count() == 0


# ---- p3 ----

PLACES = [(1, ["Rüntagarsted"], "DK", "Denmark"), (2, ["Mölmertaillar"], "ES", "Spain"), (3, ["Ny Mölmertaillar", "Other Name"], "ES", "Spain"), (4, ["Askvopevik"], "SE", "Sweden"), (5, ["Askvopevik"], "DK", "Denmark")]


@pytest.mark.parametrize("value, entry", [
    ("Rüntagarsted", 1), ("RUENTAGARSTED, Danmark", 1), ("near runtagarsted", 1), ("Remote (Rüntagarsted)", 1), ("Rüntagasted", 1), ("Rüntagarst.", 1), ("12345 Ny Mölmertaillar", 3),
    ("mölmertaillar", 2), ("other  name", 3), ("Askvopevik, DK", 5), ("Askvopevik (Sverige)", 4), ("Askvopevik", 4), ("Askvopevik, Italy", 0), ("Denmark", 0), ("Remote", 0), ("n/a", 0),
    ("Xyzzyville", 0), ("Via Larga 3, 1234 Askvopeivk - Danmark", 5), ("?", 0), ("x" * 5000, 0),
])
def test_gazetteer(value, entry):
    assert Gazetteer(PLACES).resolve(value)[0] == entry


OTHERS = [(1, ["La Chaux-de-Fonds"], "CH", "Switzerland"), (2, ["Stratford-upon-Avon"], "GB", "United Kingdom"), (3, ["Oslo"], "NO", "Norway"), (4, ["Stratfield"], "IE", "Ireland"), (5, ["Bad Soden am Taunus"], "DE", "Germany")]


@pytest.mark.parametrize("value, entry", [
    ("La Chaux de Fnds", 1), ("Stratford upon Avom", 2), ("Osli", 3), ("Isli", 0), ("Avom upon Stratford", 2), ("Stratfeild", 4), ("am Taunus, Bad Sodden", 5), ("Badsoden am Tanus", 5), ("Soden", 0),
    ("Chaux", 0), ("La Chaux de Fnds, Italy", 0), ("Oslo, Norge", 3),
])
def test_token_sets_of_any_length(value, entry):
    assert Gazetteer(OTHERS).resolve(value)[0] == entry


def test_blocks_change_no_answer(spark):
    refs = PLACES + [(i + 5, *r[1:]) for i, *r in [(r[0], *r) for r in OTHERS]]
    ref = spark.createDataFrame([(i, n[0], n[1] if len(n) > 1 else None, c, k) for i, n, c, k in refs], "place_id bigint, place_name string, alt_name string, country_code string, country_name string")
    rnd = random.Random(8)
    texts = ["Askvopevik, DK", "Askvopevik", "Ny Mölmertaillar", "Stratford-upon-Avon", "Stratfield", "near Oslo", "Denmark", "Askvopevik, Italy", "Oslo / Stratfield"]
    texts += ["".join(c for c in rnd.choice(refs)[1][0] if rnd.random() > 0.06) for _ in range(60)]
    vals = spark.createDataFrame(list(enumerate(texts)), "id bigint, v string")
    whole = sorted(map(tuple, gazetteer.map_values(vals, ref, "id", "v").collect()))
    for size in (1, 3):
        assert sorted(map(tuple, gazetteer.map_values(vals, ref, "id", "v", max_names=size).collect())) == whole
    assert sum(r[1] > 0 for r in whole) > 50


def test_map_values_edge_cases(spark):
    ref = spark.createDataFrame([(i, n[0], n[1] if len(n) > 1 else None, c, k) for i, n, c, k in PLACES], "place_id bigint, place_name string, alt_name string, country_code string, country_name string")
    vals = spark.createDataFrame([(1, "Askvopevik", "q"), (2, None, "q"), (3, " \t", "q"), (4, "Nowhere", "q"), (1, "Askvopevik", "q"), (5, "rüntagarsted", "q")], "id bigint, v string, score string")
    whole = sorted(map(tuple, gazetteer.map_values(vals, ref, "id", "v").select("id", "place_id").distinct().collect()))
    assert whole == [(1, 4), (4, 0), (5, 1)]
    blocks = sorted(map(tuple, gazetteer.map_values(vals, ref, "id", "v", max_names=2).select("id", "place_id").distinct().collect()))
    assert blocks == whole
    assert gazetteer.map_values(vals, ref.limit(0), "id", "v").where("place_id <> 0").count() == 0
    assert gazetteer.map_values(vals.limit(0), ref, "id", "v").count() == 0


def test_osa_equals_table():
    rnd = random.Random(1)

    def full(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(3000):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 7))) for _ in "ab")
        k = rnd.randint(0, 4)
        assert osa(a, b, k) == min(full(a, b), k + 1)


# ---- p4 ----


def batch(spark, rows):
    return spark.createDataFrame(rows, "id bigint, title string, company string, location string")


OLD = [
    (1, "QA Engineer, Payments", "Acme Labs ApS", "Oslo"), (2, "Senior QA Engineer, Payments", "Acme", "Oslo"), (3, "QA Engineer, Billing", "Acme", None), (4, None, "Acme", None),
    (5, "QA Engineer, Payments", None, None), (6, "", "Acme", None),
] + [(100 + i, f"QA Engineer, {t}", "Filler Firm", None) for i in range(6) for t in ("Payments", "Billing")]
NEW = [
    (11, "qa_engineer: payments (m/f/d)", "ACME Labs", "x"), (12, "Payments | QA Eng.", "Acme Labs", None), (13, "QA Engineer, Paymnets - apply now", "Acme Labs", None), (14, "Junior QA Engineer, Payments", "Acme Labs", None),
    (15, "QA Engineer, Payments", "Bravo", None), (16, "QA Engineer, Payments NEW!", "Bravo GmbH", None), (17, "QA Engineer, Payments - Oslo", "Acme Labs", "Oslo"), (18, None, None, None), (11, "qa_engineer: payments (m/f/d)", "ACME Labs", "x"),
]


def test_history_batches(spark, tmp_path):
    old, new = batch(spark, OLD), batch(spark, NEW)
    reader, _ = history.setup(old.unionByName(new))
    prep = lambda df: history.prepare(df, reader, None)
    one = history.Store(spark, str(tmp_path / "one"))
    one.absorb(prep(old))
    got = {r["id"]: r["accepted"] for r in one.absorb(prep(new)).collect()}
    assert got == {11: 1, 12: 1, 13: 1, 16: 15, 17: 1}
    # The same rows in two batches, the second against what the first has appended.
    two = history.Store(spark, str(tmp_path / "two"))
    two.absorb(prep(old))
    m1, m2 = two.absorb(prep(new.where("id <= 13"))), two.absorb(prep(new.where("id > 13")))
    assert {r["id"]: r["accepted"] for r in m1.union(m2).collect()} == got
    assert two.absorb(prep(new.limit(0))).count() == 0
    assert spark.read.parquet(str(tmp_path / "two" / "table")).count() == spark.read.parquet(str(tmp_path / "one" / "table")).count()
    # Without history only repeats within the batch are left.
    none = history.Store(spark, str(tmp_path / "none"))
    none.absorb(prep(old.limit(0)))
    assert {r["id"]: r["accepted"] for r in none.absorb(prep(new)).collect()} == {12: 11, 13: 11, 16: 15, 17: 11}
    assert {r["id"]: r["accepted"] for r in history.Store(spark, str(tmp_path / "three")).absorb(prep(new)).collect()} == {12: 11, 13: 11, 16: 15, 17: 11}


def test_what_was_accepted_stays(spark, tmp_path):
    store = history.Store(spark, str(tmp_path / "s"))
    rows = lambda *ts: history.prepare(batch(spark, [(i, t, "Acme", None) for i, t in ts]), history.TitleReader(), None)
    assert store.absorb(rows((1, "Abcdefghij"), (2, "Abcdefghxyzij"))).count() == 0
    # Close to both: it repeats the older one and does not merge them.
    assert [tuple(r) for r in store.absorb(rows((3, "Abcdefghxij"))).collect()] == [(3, 1)]
    # The same posting as 2, although close to 3, which repeats 1.
    assert [tuple(r) for r in store.absorb(rows((4, "Abcdefghxyzij"))).collect()] == [(4, 2)]
    assert {r["words"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "s" / "table")).where("batch = 0").collect()} == {"abcdefghij": 1, "abcdefghxyzij": 2}


def test_pivots_find_the_rows(spark, tmp_path, monkeypatch):
    prep = lambda df: history.prepare(df, history.TitleReader(), None)
    old, new = prep(batch(spark, OLD)), prep(batch(spark, NEW))
    monkeypatch.setattr(history, "near_pairs", lambda a, b, c: spark.createDataFrame([], "a bigint, b bigint, exact boolean"))
    store = history.Store(spark, str(tmp_path / "none"))
    store.absorb(old)
    # Only what is written alike within the batch is left: every row against the history came from the pivots.
    assert min(r["accepted"] for r in store.absorb(new).collect()) > 10


def test_short_forms_at_any_count():
    reader = history.TitleReader()
    assert reader.read("QA Eng", "") == reader.read("QA Engineer", "") == reader.read("QA Eng.", "") == ("", "engineer qa")
    assert reader.read("Senoir QA Engineer", "") == ("senior", "engineer qa")


@pytest.mark.parametrize("a, b, pairs", [
    ("engineer qa", "engineer qa", []), ("enginer qa", "engineer qa", [("enginer", "engineer")]), ("enigneer payments", "engineer paymnets", [("enigneer", "engineer"), ("payments", "paymnets")]),
    ("automation test", "testautomation", [("testautomation", "testautomation")]), ("qa", "ux", None), ("billing engineer", "engineer payments", None), ("engineer", "engineer qa", None),
])
def test_alignment(a, b, pairs):
    got = history.alignment(a, b)
    assert (got if got is None else sorted(got)) == (pairs if pairs is None else sorted(pairs))


def test_known_words_stand_against_each_other(spark):
    nodes = [("e", "", w, *history.pivot_distances(w), i) for i, w in enumerate(["collaudatore tester", "collaudatore testeur", "collaudatore tster"])]
    cols = "employer string, level string, words string, d0 int, d1 int, d2 int, d3 int, first bigint"
    new = spark.createDataFrame(nodes, cols)
    run = lambda c: {(r["a"], r["b"]) for r in history.near_pairs(new, new.withColumn("accepted", F.col("first")), spark.createDataFrame(c, "word string, n bigint")).collect()}
    assert run([("tester", 3000), ("testeur", 130), ("tster", 2)]) == {(2, 0)}
    assert run([("tester", 300), ("testeur", 2), ("tster", 2)]) == {(1, 0), (2, 0)}


def test_pivot_join_loses_no_pair(spark):
    rnd = random.Random(5)
    titles = sorted({" ".join(sorted("".join(rnd.choices("abcdefgh", k=rnd.randint(4, 9))) for _ in range(rnd.randint(1, 2)))) for _ in range(60)})
    for t in list(titles):
        for _ in range(3):
            i = rnd.randrange(len(t))
            titles.append(" ".join(sorted((t[:i] + rnd.choice(["", "x", t[i] + "y"]) + t[i + 1 :]).split())))
    titles = sorted({t for t in titles if t})
    rows = [("e", "", t, *history.pivot_distances(t), i) for i, t in enumerate(titles)]
    nodes = spark.createDataFrame(rows, "employer string, level string, words string, d0 int, d1 int, d2 int, d3 int, first bigint")
    got = {(r["a"], r["b"]) for r in history.near_pairs(nodes, nodes.withColumn("accepted", F.col("first")), spark.createDataFrame([], "word string, n bigint")).collect()}
    want = {(j, i) for i, j in itertools.combinations(range(len(titles)), 2) if history.alignment(titles[j], titles[i]) is not None}
    assert got == want and len(want) > 100


def test_all_batches_at_once_give_what_a_store_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FEW", 20)  # some employers' titles meet by ranges, some all
    rnd = random.Random(8)
    roles = ["QA Engineer, Payments", "QA Engineer, Billing", "Senior QA Engineer, Payments", "Abcdefghij", "Abcdefghxyzij", "Tester", "Testeur", "Data Analyst Onboarding", "Dataanalyst Onboarding"]

    def typed(t):
        for _ in range(rnd.choice([0, 0, 1, 2])):
            i = rnd.randrange(1, len(t))
            t = t[:i] + rnd.choice(["", t[i - 1], "x" + t[i - 1]]) + t[i:]
        return t

    rows = [(i, b, typed(rnd.choice(roles)), rnd.choice(["Acme", "Acme", "Bravo"]), None) for b in range(3) for i in range(b * 100, b * 100 + (150 if b == 0 else 30))]
    rows += [rows[-1], (900, 2, None, "Acme", None), (901, 2, "Tester", None, None), (902, 2, "", "Acme", None)]
    df = spark.createDataFrame([(i + (b > 0) * 100, b, *rest) for i, b, *rest in rows], "id bigint, batch int, title string, company string, location string")
    prepared = history.prepare(df, history.TitleReader(), None)
    store, want = history.Store(spark, str(tmp_path / "s")), []
    for b in range(3):
        got = store.absorb(prepared.where(F.col("batch") == b).drop("batch"))
        want += [tuple(r) for r in got.collect()] if b else []
    assert sorted(tuple(r) for r in history.repeats(prepared).collect()) == sorted(want) and len(want) > 30
    assert history.repeats(prepared.limit(0)).count() == 0


def _p4(spark, path, old, new):
    """p4_found over these rows of the two tables and no places, with the number of its jobs."""
    columns = "title string, company string, location string"
    spark.createDataFrame(old, f"record_id bigint, {columns}").write.parquet(f"{path}/seen_jobs.parquet")
    spark.createDataFrame(new, f"record_id bigint, batch_no int, {columns}").write.parquet(f"{path}/arrivals.parquet")
    spark.createDataFrame([], "place_id bigint, place_name string, country_code string, country_name string, alt_name string").write.parquet(f"{path}/places.parquet")
    spark.sparkContext.setJobGroup(str(path), "")
    got = sorted(tuple(r) for r in queries.p4_found(spark, str(path)).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(path)))
    spark.sparkContext.setJobGroup("", "")
    return got, jobs


def test_batches_cost_no_rounds_of_their_own(spark, tmp_path):
    new = lambda n: [(r[0], 1 + k * n // len(NEW), *r[1:]) for k, r in enumerate(sorted(NEW, key=lambda r: r[0]))]
    want = [(1, 11), (1, 12), (1, 13), (1, 17), (15, 16)]
    got, one = _p4(spark, tmp_path / "one", OLD[:4] + OLD[6:], new(1))
    assert got == want
    got, eight = _p4(spark, tmp_path / "eight", OLD[:4] + OLD[6:], new(8))
    assert got == want and eight < one + 8


def test_history_first_whatever_its_ids(spark, tmp_path):
    old = [(500 + i, *rest) for i, *rest in OLD if i < 4]
    got, _ = _p4(spark, tmp_path / "t", old, [(i, 1 if i < 14 else None, *rest) for i, *rest in NEW])
    assert got == [(15, 16), (501, 11), (501, 12), (501, 13), (501, 17)]
    assert _p4(spark, tmp_path / "none", [], [(i, None, *rest) for i, *rest in NEW])[0] == [(11, 12), (11, 13), (11, 17), (15, 16)]


# ---- p5 ----


@pytest.mark.parametrize("a, b, link", [
    ("bisuvex drebatan software", "bis uvex drebatan software", 2), ("bisuvex drebatan software", "bisuvexdrebatan sw", 2), ("bisuvex drebatan software", "software drebatan bisuvex", 2),
    ("bisuvex drebatan software", "bisuvex drebatan", 1), ("bisuvex drebatan software", "bisvuex drebatan software hq", 2), ("bisuvex drebatan software", "bisuvex drebatan marine", 0),
    ("katarina lokeser lekukan law", "christoffer lokeser lekukan law", 0), ("katarina lokeser lekukan law", "k lokeser lekukan law", 1), ("katarina lokeser lekukan law", "kaja lokeser lekukan law", 1),
    ("katarina lokeser lekukan law", "lokeser lekukan katarina law", 2), ("k lokeser lekukan law", "c lokeser lekukan law", 0), ("acme", "acne", 0), ("", "acme", 0),
])
def test_compare_names(a, b, link):
    assert names.compare(a, b) == link == names.compare(b, a)


def test_link_names(spark):
    groups = [
        ["bisuvex drebatan software", "bis uvex drebatan software", "bisuvexdrebatan sw", "bisuvex drebatan", "bisuvex drebatan software holding"],
        ["katarina lokeser lekukan law", "kaja lokeser lekukan law"], ["christoffer lokeser lekukan advisory", "christoffer lokeser lekuukan advisory"], ["lonely company"],
        ["frederik hinilol grotinis design", "fred hinilol grotinis design", "f hinilol grotinis design"],
    ]
    apart = ["f noravol gumavis", "frederik noravol gumavis law", "francisca noravol gumavis design"]
    rows = [(n, 1) for g in groups for n in g] * 2 + [(n, 1) for n in apart] + [(None, 1), ("", 1), (" ", 1), ("z" * 3000, 1)]
    df = spark.createDataFrame(rows, "company string, name int")
    got = {(r["key_a"], r["key_b"]) for r in names.pairs_of(names.link(df, "company")).collect()}
    assert got == {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}
    assert names.link(df.limit(0), "company").count() == 0


def test_the_index_finds_what_is_accepted(spark):
    rnd = random.Random(12)
    stems = ["thunderbolt", "kristoffersen", "noravolsendahl", "acrebit", "bisuvexdrebatanlokeser", "hinilol", "vega", "grotinis lekukan", "f kristoffersen", "frederik kristoffersen", "thunderbolt law"]

    def spoil(n):
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(n))
            n = rnd.choice([n[:i] + n[i + 1 :], n[:i] + rnd.choice("aeiour") + n[i:], n[:i] + rnd.choice("aeiour") + n[i + 1 :], n[: i - 1] + n[i : i + 1] + n[i - 1 : i] + n[i + 1 :]])
        return " ".join(n.split())

    all_names = sorted({spoil(rnd.choice(stems)) for _ in range(220)} | {"thunderbolt", "thanderbelt", "kristaffersin", "kristoffersen"} - {""})
    df = spark.createDataFrame([(n,) for n in all_names], "name string")
    met = {(r["a"], r["b"]) for r in names.candidates(df).collect()}
    accepted = {p for p in itertools.combinations(all_names, 2) if names.compare(*p)}
    assert accepted <= met and ("thanderbelt", "thunderbolt") in accepted and ("kristaffersin", "kristoffersen") in accepted
    assert len(accepted) > 300


def test_long_names_in_any_order():
    words = "bisuvex drebatan lokeser lekukan hinilol grotinis".split()
    assert names.compare(" ".join(words), " ".join(reversed(words))) == 2
    assert names.compare(" ".join(words), " ".join(words[3:] + ["bisuvx", "drebatan", "lokseer"])) == 2
    assert names.compare(" ".join(words), " ".join(words[1:] + ["vumavin"])) == 0
    rnd = random.Random(3)
    for _ in range(3000):
        a, b = (tuple(rnd.choice(["bisuvex", "bisuve", "bisuvxe", "b", "bisu", "isuvex", "drebatan"]) for _ in range(4)) for _ in "ab")
        x, y = names._assign(a, b), names._assign_many(a, b)
        assert (x is None) == (y is None) and (x is None or sum(x) == sum(y))


def test_weak_links_to_the_end(spark):
    # Each weak link decides only once the one before it is settled.
    chain = ["drebatan lokeser" + t for t in ("", " law", " law marine", " law marine design")]
    df = spark.createDataFrame([(n,) for n in chain], "name string")
    again = names.link(df, "name")
    assert {r["entity"] for r in again.collect()} == {min(chain)} and again.count() == len(chain)


def test_names_of_a_hot_block_meet(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: rnd.choice("acdeghijklmnop") + "".join(rnd.choices("aeioulnrstv", k=rnd.randint(3, 7)))
    want = [("f castellanova", "frederik castellanova"), ("bob castellanova", "robert castellanova"), ("castellanova", "castellanovo")]
    all_names = {n for p in want for n in p}
    while len(all_names) < 250:
        w = word()
        all_names |= {f"{w} castellanova", rnd.choice([f"castellanova {w}", f"{w[0]} castellanova", f"{w[:-1]} castellanova law", f"{w[:2]} {w[2:]} castellanova", f"{w}castellanova", f"{w[1:]} castel lanova"])}
    assert len(all_names) > names.HOT
    df = spark.createDataFrame([(n,) for n in sorted(all_names)], "name string")
    meeting = lambda: {(r["a"], r["b"]) for r in names.candidates(df).collect()}
    met = meeting()
    monkeypatch.setattr(names, "HOT", 10**6)
    whole = meeting()
    accepted = {p for p in whole if names.compare(*p)}
    assert len(accepted) > 100 and accepted <= met and met <= whole
    # What the index and the test of letters leave out is nothing that would be accepted.
    every = {p for p in itertools.combinations(sorted(all_names), 2) if names.compare(*p)}
    assert every == accepted and len(met) < len(all_names) * (len(all_names) - 1) / 4
    monkeypatch.undo()
    far = [n for n in all_names if n[:2] not in ("f ", "b ")]
    linked = {(r["key_a"], r["key_b"]) for r in names.pairs_of(names.link(df.where(F.col("name").isin(far + ["f castellanova"])), "name")).collect()}
    assert set(want) <= linked


def test_a_common_word_alone_brings_no_names_together(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bcdfghjklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.choice([2, 3, 4])))
    others = sorted({f"christoffer {word()} {word()} law" for _ in range(300)})
    want = [("christoffer lokeser lekukan law", "christoffer lokser lekukan"), ("christoffer anna law", "christoffer a"), ("christoffer bob law", "christoffer robert"), ("christoffer lekukan", "cristoffer lekukann")]
    every = sorted(set(others) | {n for p in want for n in p})
    met = {(r["a"], r["b"]) for r in names.candidates(spark.createDataFrame([(n,) for n in every], "name string")).collect()}
    accepted = {p for p in itertools.combinations(every, 2) if names.compare(*p)}
    assert {tuple(sorted(p)) for p in want} <= accepted <= met and len(met) < len(every) ** 2 / 12


def test_long_nicknames_stand_for_names():
    assert names.compare("sander lokeser lekukan law", "alexander lokeser lekukan law") == 1


# ---- p6 ----

CLAIM = "grp string, source string, f string, e string, at timestamp, id bigint, rank int, first_id string"


def test_truth_by_rank(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [
        ("g", "low", "A", None, t(9), 1, 9), ("g", "low2", "A", None, t(9), 2, 8), ("g", "top", "B", None, t(1), 3, 1), ("g", "top", "C", None, t(2), 5, 1), ("g", "top", "D", None, t(2), 4, 1),
        ("g", "low", None, None, t(1), 6, 9), ("h", None, "X", "Y", None, 7, None), (None, "top", "Y", None, t(1), 8, 1), ("g", "top", "D", None, t(2), 4, 1),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], CLAIM)
    truths, _ = truth.discover(truth.gather(df, ["f", "e"]), ["f", "e"])
    assert sorted(map(tuple, truths.collect())) == [("g", 1, 6, 4, "D", None, None), ("h", 7, 7, 7, "X", 7, "Y")]
    assert truth.discover(truth.gather(df.limit(0), ["f"]), ["f"])[0].count() == 0


def test_truth_learns_who_is_right(spark):
    rnd = random.Random(2)
    rows = []
    for g in range(60):
        for s, p in (("good1", 0.95), ("good2", 0.9), ("bad1", 0.2), ("bad2", 0.2), ("bad3", 0.2)):
            rows.append((f"g{g}", s, "right" if rnd.random() < p else f"wrong{rnd.randint(0, 2)}", None, dt.datetime(2025, 1, 1), len(rows), None, ""))
    df = spark.createDataFrame(rows, CLAIM)
    truths, sources = truth.discover(truth.gather(df, ["f"]), ["f"])
    w = {r["source"]: r["reliability"] for r in sources.collect()}
    assert min(w["good1"], w["good2"]) > max(w["bad1"], w["bad2"], w["bad3"])
    assert truths.where(F.col("f") == "right").count() >= 56
    # Of one declared rank: the estimates decide, also against more votes of a worse rank.
    ranked = df.withColumn("rank", F.when(F.col("source").startswith("good"), 1).otherwise(2))
    right = {r["grp"] for r in rows_of(df, "good1", "right").intersect(rows_of(df, "good2", "right")).collect()}
    got = {r["grp"] for r in truth.discover(truth.gather(ranked, ["f"]), ["f"])[0].where("f = 'right'").collect()}
    assert right <= got


def rows_of(df, source, value):
    return df.where((F.col("source") == source) & (F.col("f") == value)).select("grp")
