import pytest

from selvedge.llm.pii import Finder, Knowledge, SemiMarkovCrf, find_personal_data, finder_for, plain_with_positions, replace_personal_data, segments, training_vocabulary
from selvedge.llm.pii_training import GIVEN_NAMES, Maker

SCHEMA = "tbl string, row_index bigint, field string, msg bigint, text string"


@pytest.fixture(scope="module")
def finder():
    return Finder(set(GIVEN_NAMES), frozenset())


def test_held_out_accuracy(finder):
    know = Knowledge(set(GIVEN_NAMES), training_vocabulary().__contains__)
    model, maker = SemiMarkovCrf(finder.weights), Maker(12345)
    hit = found = true = 0
    for _ in range(400):
        text, gold = maker.text()
        got = {(s[0], s[2]) for s in model.best(text, segments(text, know))}
        want = {(a, k) for a, _, k in gold}
        hit, found, true = hit + len(got & want), found + len(got), true + len(want)
    assert hit / found > 0.97 and hit / true > 0.97


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("Please write to ann.lee_3 [at] mail.example [dot] org soon.", "EMAIL", "ann.lee_3"),
        ("My mobile is +33 6 12 34 56 78 if needed.", "PHONE", "+33 6"),
        ("Call me on (212) 555-0199.", "PHONE", "(212)"),
        ("My social security number is 991-27-1057.", "ID_NUMBER", "991"),
        ("Passport QX198163B was shown.", "ID_NUMBER", "QX198163B"),
        ("J'habite au 154 bis quai du Canal, Montville.", "ADDRESS", "154 bis"),
        ("Deliver it to 12 Old Mill Road, Springtown 00123 please.", "ADDRESS", "12 Old"),
        ("My name is Clara Zorbelin.", "NAME", "Clara"),
        ("Kind regards, Dr. M. Druvo.", "NAME", "M. Druvo"),
    ],
)
def test_kinds(finder, text, kind, piece):
    assert (text.index(piece), kind) in {(a, k) for a, _, k in finder(text)}


@pytest.mark.parametrize(
    "text",
    ["Lot 0199423825 was withdrawn in 2021.", "Blood pressure read 143/90 on 2023-04-13.", "Article no. 50.238.8516 describes the device.", "Follow @cityhealth for news.", "A nurse may teach you how.", "The value stood at 36.7 degrees.", "Reference interval 135-145, result 560.76.", ""],
)
def test_no_cases(finder, text):
    assert finder(text) == []


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("Call me on 0612345678/0698765432.", [("0612345678", "PHONE"), ("0698765432", "PHONE")]),
        ("My social security number is 185057800608436/0612345678.", [("185057800608436", "ID_NUMBER"), ("0612345678", "PHONE")]),
        ("Tel: 01 23 45 67 89/06 12 34 56 78.", [("01 23 45 67 89", "PHONE"), ("06 12 34 56 78", "PHONE")]),
        ("Tel: 01 23 45 67 89.", [("01 23 45 67 89", "PHONE")]),
    ],
)
def test_joined_numbers_are_told_apart(finder, text, pieces):
    assert [(text[a:b], k) for a, b, k in finder(text)] == pieces


def test_long_digit_runs_take_time_in_proportion(finder):
    text = "Values 12 345 678 " + "90 123 " * 3000
    finder(text)
    assert len(segments(text, finder.prepared()[0])) < 20 * 2 * 6003


@pytest.mark.parametrize("address", ["jean.x<at>mail.fr", "jean.x{at}mail.fr", "jean.x(chez)mail.fr", "jean.x [chez] mail.fr", "jean.x{chez}mail.fr", "jean.x <chez> mail.fr"])
def test_every_spelling_of_the_at_sign_is_looked_for(finder, address):
    text = f"Write to {address} please."
    assert finder(text) == [(9, 9 + len(address), "EMAIL")]


def test_positions_survive_odd_characters(finder):
    text = "é​​x． My name is Cl​ara Zorbelin."
    plain, at = plain_with_positions(text)
    assert "Clara" in plain and text[at[plain.index("Clara")]] == "C"
    assert (text.index("Cl"), "NAME") in {(a, k) for a, _, k in finder(text)}


def test_tables(spark):
    long = "nothing here. " * 20000 + "Call me on (212) 555-0199."
    rows = [("t", 1, "f", 0, "Tel: 01 23 45 67 89."), ("t", 1, "f", 0, "Tel: 01 23 45 67 89."), ("t", 2, "f", 0, None), ("t", 3, "f", 0, ""), ("t", 4, "f", 1, long)]
    df = spark.createDataFrame(rows, SCHEMA)
    finder = finder_for(df)
    got = sorted((r.row_index, r.msg, r.kind, r.start_pos) for r in find_personal_data(df, finder).collect())
    assert got == [(1, 0, "PHONE", 5), (1, 0, "PHONE", 5), (4, 1, "PHONE", long.index("(212)"))]
    out = {r.row_index: (r.text, r.replaced) for r in replace_personal_data(df, finder).collect()}
    assert out[1] == ("Tel: <PHONE>.", 1) and out[2] == (None, 0) and out[3] == ("", 0)
    assert len(out[4][0]) == len(long) - len("(212) 555-0199") + len("<PHONE>")
    empty = spark.createDataFrame([], SCHEMA)
    assert find_personal_data(empty, finder_for(empty)).count() == 0


def test_training_sentences_are_not_those_of_the_tables(sf):
    import glob
    import re

    import duckdb

    from selvedge.llm.pii_training import BLOCKS, CARRIERS, DECOYS

    con = duckdb.connect()
    parts = [f"select {c} as t from read_parquet('{f}')" for name, cs in (("sft_records", ("instruction", "response")), ("preference_triples", ("prompt",)), ("documents", ("text",))) for f in glob.glob(f"{sf}/{name}.parquet") for c in cs]
    text = re.sub(r"\s+", " ", "\n".join(r[0] or "" for r in con.execute(" union all ".join(parts)).fetchall()).lower())
    made = [t for ts in CARRIERS.values() for t in ts] + [b for b, _ in BLOCKS] + DECOYS
    found = [t for t in made if (ls := [x.strip().lower() for x in re.split(r"\{\w*\}", t) if len(x.strip()) > 6]) and all(x in text for x in ls)]
    assert found == []


def test_time_grows_in_proportion_to_a_text_of_numbers(finder):
    import time

    def took(n):
        began = time.time()
        finder("12 345 678 " * n)
        return time.time() - began

    took(500)
    assert took(6000) < 5 * took(2000) + 1
