import datetime as dt
import random

import pytest

from knotwork.llm import scans

SCHEMA = (
    "chunk_id string, document_id string, chunk_index int, content string, title string, document_type string,"
    " metadata string, ingested_at timestamp, word string"
)
OCR = '{"extraction_method": "OCR"}'
AT = dt.datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(c, d, i, t, ti, kind, m, AT, "x") for c, d, i, t, ti, kind, m in rows], SCHEMA)


CLEAN = "the machine compares every modern registry with low-latency measures of the garden during summer " * 6
PAGES = [
    ("s0", "s", 0, "  Garden report    1\n\nthe rnachine compares every mod-\nern registry during low-\nlatency", "Garden report", "pdf", OCR),
    ("s1", "s", 1, "Gorden report    2\nmea5ures of the garden com-\n\n- 2 -", "Garden report", "pdf", None),
    ("s2", "s", 2, "Garden rep0rt    3\npares the machine\n- 3 -", "Garden report", "pdf", OCR),
    ("c0", "c", 0, CLEAN, "Clean", "md", "{}"),
]


def cases(df):
    return {(r["chunk_id"], r["line_no"], r["kind"], r["word"]) for r in scans.repairs(df)[1].collect()}


def test_furniture_broken_and_misread_words(spark):
    assert cases(table(spark, PAGES)) == {
        ("s0", 0, "furniture", ""), ("s1", 0, "furniture", ""), ("s1", 3, "furniture", ""), ("s2", 0, "furniture", ""),
        ("s2", 2, "furniture", ""), ("s0", 2, "misread", "machine"), ("s0", 2, "broken", "modern"),
        ("s0", 3, "broken", "low-latency"), ("s1", 1, "broken", "compares"), ("s1", 1, "misread", "measures"),
    }


def test_pages_become_continuous_text(spark):
    rows = {r["chunk_id"]: (r["continues"], r["text"]) for r in scans.repaired_pages(table(spark, PAGES)).collect()}
    assert rows["s0"] == (True, "the machine compares every modern registry during low-latency")
    assert rows["s1"] == (True, "measures of the garden compares")


def test_paragraphs_run_over_page_ends(spark):
    pages = PAGES + [
        ("t0", "t", 0, "  First lines of a text that\ngoes on and ends here.\n\nAnother paragraph that has no end at the", "T", "png", None),
        ("t1", "t", 1, "Garden of the page.\nDone.", "T", "png", None), ("t2", "t", 2, "A new paragraph.", "T", "png", None),
    ]
    got = {}
    for r in scans.repaired_paragraphs(table(spark, pages)).orderBy("document_id", "paragraph").collect():
        got.setdefault(r["document_id"], []).append((r["first_page"], r["last_page"], r["text"]))
    assert got["s"] == [(0, 2, "the machine compares every modern registry during low-latency measures of the garden compares the machine")]
    assert got["t"] == [
        (0, 0, "First lines of a text that goes on and ends here."), (0, 1, "Another paragraph that has no end at the Garden of the page. Done."), (2, 2, "A new paragraph."),
    ]
    assert scans.repaired_paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_misread_words_are_looked_up(spark):
    long = "electroencephalographically" * 2 + "measured"
    rows = [("s0", "s", 0, "it was " + long.replace("measured", "rneasured") + " again", None, "png", None), ("c0", "c", 0, f"it was {long} again " * 30, None, "md", None)]
    assert len(long) > 60 and cases(table(spark, rows)) == {("s0", 0, "misread", long)}


def test_repeated_lines_are_found_by_common_runs():
    lines = ("tgardenreportoftheyear", "tquarterlyminutes", "bshort")
    assert scans.known_line("gardenreportotheyear", "t", lines) and scans.known_line("quarterlyminutes", "t", lines)
    assert not scans.known_line("gardenreportotheyear", "b", lines) and not scans.known_line("somethingelseentirely", "t", lines)


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [
        ("a", "s", 0, None, None, "png", None), ("b", "s", 1, "", None, "png", None), ("c", "s", 2, " \n ", None, "png", None),
        (None, "s", 3, "x-\ny", None, "png", None), ("d", None, 0, "x-\ny", None, "png", None),
        ("e", "s", 4, "half-\nway", None, "png", None), ("e", "s", 4, "half-\nway", None, "png", None),
        ("f", "s", 5, "word " * 5000, None, "png", None),
    ]
    assert cases(table(spark, rows)) == {("e", 0, "broken", "halfway")}
    assert cases(spark.createDataFrame([], SCHEMA)) == set()


def brute(words, word, most):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            nxt = [i]
            for j, y in enumerate(b, 1):
                nxt.append(min(nxt[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = nxt
        return row[-1]

    return {w for w in words if lev(w, word) <= most}


@pytest.mark.parametrize("word", ["machlne", "a", "", "registries", "gardn", "gradn"])
def test_automaton_finds_every_word_within_reach(word):
    words = ["machine", "machines", "garden", "guard", "a", "an", "registry", "registers"]
    trie = scans.Trie([(w, 1) for w in words])
    for most in (0, 1, 2, 3):
        assert {w for w, _ in trie.within(word, most)} == brute(words, word, most)


@pytest.mark.parametrize(("line", "is_number"), [
    ("- 6O -", True), ("[S7/57]", True), ("Page 1 of 8", True), ("หน้า 12", True), ("1v", True), ("xiv", True),
    ("1998.", False), ("the 12", False), ("9.8 Lexical schemas", False), ("mix of it", False),
])
def test_page_numbers(line, is_number):
    assert scans.is_page_number(line) == is_number


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_gives_every_word_within_reach():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
    vocabulary = sorted({word() for _ in range(300)} | {"a" * 70, "a" * 35 + "b" * 35})
    trie = scans.Trie([(w, 1) for w in vocabulary])
    for most in range(4):
        for asked in [word() for _ in range(60)] + ["a" * 68, "a" * 36 + "b" * 34]:
            assert sorted(w for w, _ in trie.within(asked, most)) == [w for w in vocabulary if edits(asked, w) <= most]
