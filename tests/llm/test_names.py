import random

import pytest

from knotwork.llm import names

NODES = "node_id string, text string, type string, occurrences long, text2 string"
NICKS = "formal_name string, short_name string, type string"


def groups(spark, rows, nicks=(("Robert", "Bob", "x"),)):
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else 1, "x") for r in rows], NODES)
    got = names.same_pairs(names.entities(df, spark.createDataFrame(list(nicks), NICKS))).collect()
    return {(r["node_id_a"], r["node_id_b"]) for r in got}


def every(*ids):
    return {(a, b) for a in ids for b in ids if a < b}


def test_persons(spark):
    rows = [
        ("a1", "Robert Malvenador", "PERSON", 9), ("a2", "Malvenador, Bob", "PER"), ("a3", "R. Malvenador", "person"),
        ("a4", "Dr. Robert Malvneador", "Person"), ("a5", "MALVENADOR Robert", "PERSON"), ("a6", "RobertMalvenador", "PERSON"),
        ("a7", "Robért J. Malve-nador (ret.)", "PERSON"), ("b1", "Gisela Malvenador", "PERSON", 3),
        ("b2", "คุณGisela Malvenador", "PERSON"), ("c1", "Robert Quistelborn", "PERSON", 4), ("d1", "Malvenador", "LOCATION"),
        ("a8", "Robert Malvenadoor's", "PERSON"),
    ]
    assert groups(spark, rows) == every("a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8") | every("b1", "b2")


def test_organisations(spark):
    rows = [
        ("a1", "Zortavelin Northern Services", "ORGANIZATION", 9), ("a2", "Zortavelin Northern & Services Co., Ltd.", "ORG"),
        ("a3", "บริษัท Zortavelin Northern Services จำกัด (มหาชน)", "COMPANY"), ("a4", "Zortavelin Nth Svcs", "ORG"),
        ("a5", "Northern Services (Zortavelin)", "ORG"), ("a6", "Zortavelin N.S.", "ORG"), ("a7", "Zortavelin", "ORG"),
        ("a8", "Zortaevlin Northren Services GmbH", "ORG"), ("a9", "Services Zortavelin Northern", "ORG"),
        ("b1", "Kelmarodin Northern Services", "ORG", 2), ("b2", "The Kelmarodin Northern and Services Group", "ORG"),
        ("p1", "Zortavelin Northern Services", "PRODUCT"),
    ]
    assert groups(spark, rows) == every(*[f"a{i}" for i in range(1, 10)]) | every("b1", "b2")


def test_equal_text_under_labels_of_one_kind_and_repeats(spark):
    rows = [("x", "Ann Bellweather", "PERSON"), ("y", "Ann Bellweather", "PER"), ("x", "Ann Bellweather", "PERSON"), ("z", "Ann Bellweather", "ORG")]
    assert groups(spark, rows) == {("x", "y")}


def test_nulls_blanks_long_and_empty(spark):
    rows = [
        ("a", None, "PERSON"), ("b", "", "PERSON"), ("c", " !!", "ORG"), (None, "Ann Bellweather", "PERSON"),
        ("d", "Ann Bellweather", None), ("e", "x" * 5000 + " y", "PERSON"), ("f", "x" * 5000 + " y", "PER"), ("g", "Q" * 3000, "ORG", None),
    ]
    assert groups(spark, rows) == {("e", "f")}
    empty = spark.createDataFrame([], NODES)
    assert names.entities(empty, spark.createDataFrame([], NICKS)).count() == 0


@pytest.mark.parametrize(("text", "hypothesis"), [
    ("Nell, Ada Q.", ("plain", "nell", "ada", "")),
    ("Prof. Ada Nellwood", ("plain", "nellwood", "ada", "")),
    ('Ada "Addy" Nellwood', ("plain", "nellwood", "ada", "")),
    ("Nellwood A", ("plain", "nellwood", "a", "")),
])
def test_parse_person(text, hypothesis):
    assert names.parse_person(text)[0][0] == hypothesis


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def spelt(rng, first, last):
    """A name as somebody types it: turned, with an initial, or with one typo in the surname."""
    kind = rng.random()
    if kind < 0.25:
        return f"{last}, {first}"
    if kind < 0.4:
        return f"{first[0]}. {last}"
    i, c = rng.randrange(1, len(last) - 1), rng.choice(LETTERS)
    if kind < 0.7:
        last = rng.choice([last[:i] + last[i + 1 :], last[:i] + c + last[i:], last[:i] + c + last[i + 1 :], last[: i - 1] + last[i] + last[i - 1] + last[i + 1 :] if i > 1 else last])
    return f"{first} {last}"


def test_recall_of_made_up_people(spark):
    rng = random.Random(5)
    people = [("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)), "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(5))) for _ in range(120)]
    rows, want = [], set()
    for k, (first, last) in enumerate(people):
        texts = {f"{first} {last}".title(): 40} | {spelt(rng, first, last).title(): 1 for _ in range(6)}
        ids = [f"{k:03d}-{i}" for i in range(len(texts))]
        rows += [(i, t, "PERSON", n) for i, (t, n) in zip(ids, texts.items())]
        want |= {(a, b) for a in ids for b in ids if a < b}
    df = spark.createDataFrame(rows, "node_id string, text string, type string, occurrences long")
    none = spark.createDataFrame([], "formal_name string, short_name string")
    members = names.entities(df, none)
    got = {tuple(r) for r in names.same_pairs(members).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.99
    assert {tuple(r) for r in names.same_pairs(members, block=2).collect()} == got


def test_typos_in_long_names_and_null_hypothesis(spark):
    long = "consolidated" * 9
    rows = [("a", f"{long} Trading Partners Ltd", "ORG", 9), ("b", f"{long[:70]}x{long[70:]} Trading Partners", "company", 1), ("c", f"{long[1:]} Trading Partners", "ORG", 1), ("d", "Quite Another Name Inc", "ORG", 1)]
    df = spark.createDataFrame(rows, "node_id string, text string, type string, occurrences long")
    members = {r["node_id"]: r["entity"] for r in names.entities(df, spark.createDataFrame([], "formal_name string, short_name string")).collect()}
    assert members["a"] == members["b"] == members["c"] != members["d"]
    found = spark.createDataFrame([("x", "y", 1, 1000, "turned", "heard", "heard", "none"), ("v", "w", 1000, 1, "plain", "drop", "same", "same")], "s string, c string, weight long, own_weight long, form string, main_op string, a_op string, b_op string")
    assert [r["s"] for r in names.attached(found, rounds=1).collect()] == ["v"]


def test_circles_and_long_chains_have_one_root(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)]
    circle = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("p", "q"), ("q", "p")]
    got = {r["s"]: r["root"] for r in names.roots(spark.createDataFrame(chain + circle, "s string, c string")).collect()}
    assert {got[s] for s, _ in chain} == {"n0300"} and {got[x] for x in "abcd"} == {"a"} and got["q"] == "p"
