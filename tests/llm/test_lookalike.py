import itertools
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from knotwork.llm import lookalike

SCHEMA = "doc_id long, text string, form string"


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    return {(r["doc_id_a"], r["doc_id_b"]) for r in lookalike.alike_pairs(df).collect()}


ALIKE = [
    "The low-cost résumé for น้ำ and ที่นี่ at 20",
    "Ｔhe low-cost résumé for น้ำ and ที่นี่ at 20",
    "The low‑cost résumé for น้ํา and ที่นี่ at 20",
    "T​he low-c­ost résumé for น้ำ and ท่ีนี่ at 20",
    "Тhе lоw-соst résumé fоr น้ำ аnd ที่นี่ аt 20",
]
DIFFERENT = [
    "the low-cost résumé for น้ำ and ที่นี่ at 20",
    "The low-cost resume for น้ำ and ที่นี่ at 20",
    "The low-cost résumé for น้ำ and ที่นี่ at 21",
    "The low-cost résumé for น้ำ and ที่นี่ at 20!",
    "The  low-cost résumé for น้ำ and ที่นี่ at 20",
    "The\nlow-cost résumé for น้ำ and ที่นี่ at 20",
]


def test_alike_texts_pair_and_different_ones_do_not(spark):
    assert pairs(spark, ALIKE + DIFFERENT) == set(itertools.combinations(range(len(ALIKE)), 2))


def test_copies_are_not_paired_with_each_other(spark):
    assert pairs(spark, [ALIKE[0], ALIKE[0], ALIKE[1]]) == {(0, 2), (1, 2)}


def test_nulls_empty_long_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, ""), (None, "a", ""), (None, "а", ""), (2, "", ""), (3, "​", ""), (4, "x" * 200_000, "")], SCHEMA)
    assert {tuple(r) for r in lookalike.alike_pairs(df).collect()} == {(2, 3)}
    assert lookalike.alike_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forms_are_spelt_in_one_script(spark):
    texts = ["простая система работает хорошо", "a plain setup holds a book", "сhapter оf а bооk"]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(9, "a lot to do " * 20, "")]
    forms = {r["doc_id"]: r["form"] for r in lookalike.consistent_form(spark.createDataFrame(rows, SCHEMA)).collect()}
    del forms[9]
    assert forms == {0: texts[0], 1: texts[1], 2: "chapter of a book"}


MARKED = [("ä", "ӓ", "а\u0308"), ("ö", "ӧ", "о\u0308"), ("ë", "ё", "е\u0308"), ("ï", "ї", "і\u0308"), ("ó", "ό", "ο\u0301"), ("á", "ά", "а\u0301")]


@pytest.mark.parametrize("marked", MARKED)
def test_marked_letters_look_like_their_twins(spark, marked):
    texts = [f"H{c}r w{d}g" for c in (*marked, unicodedata.normalize("NFD", marked[0])) for d in (marked[0], marked[2])]
    assert len({lookalike.skeleton(t) for t in texts}) == 1
    assert lookalike.skeleton(texts[0]) != lookalike.skeleton(f"H{unicodedata.normalize('NFD', marked[0])[0]}r w{marked[0]}g")
    if marked == MARKED[0]:
        assert pairs(spark, texts) == set(itertools.combinations(range(len(texts)), 2))


def test_marked_letters_are_spelt_in_one_script(spark):
    texts = ["ещё простая за\u0301мок система", "größer schön"]
    forms = {r["doc_id"]: r["form"] for r in lookalike.consistent_form(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert forms == dict(enumerate(texts))


@given(st.text(max_size=40))
def test_skeleton_is_stable_under_normalisation(text):
    want = lookalike.skeleton(text)
    assert lookalike.skeleton(unicodedata.normalize("NFD", text)) == want
    assert lookalike.skeleton("​".join(text)) == want or lookalike.IGNORABLE.search(text)


def brute(token, score, unseen):
    best = None
    for path in itertools.product(*[lookalike.LOOKS.alternatives.get(c, (c,)) for c in token]):
        s = "".join(path)
        cost = -sum(score.get(p, unseen) for p in zip(" " + s, s + " "))
        cost += lookalike.SWITCH * sum(lookalike.script(a[-1]) != lookalike.script(b[0]) for a, b in zip(path, path[1:]))
        best = min(best or (cost, s), (cost, s))
    return best[1]


@pytest.mark.parametrize("token", ["oca", "cop", "ma", "wo", "xa", "тac", "иc", "pecm"])
def test_viterbi_equals_all_paths(token):
    score = {("о", "с"): -1.0, (" ", "о"): -1.0, ("r", "n"): -0.5, ("c", "o"): -0.7, ("с", "о"): -0.9, ("v", "v"): -3.0}
    assert lookalike.best_spelling(token, score, -5.0) == brute(token, score, -5.0)


def test_letters_of_the_public_table(spark):
    more = lookalike.confusable_letters(spark)
    assert more[0x4C0] == "l" and more[0x433] == "r" and not any(p.isdigit() for p in more.values())
    texts = ["alтo", "aӀтo"]  # a palochka for the letter l
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    assert {tuple(r) for r in lookalike.alike_pairs(df).collect()} == {(0, 1)}


def test_classes_count_what_is_alike_but_not_equal(spark):
    texts = ["scope", "scоpe", "scope", "scopе", "other", None, " ​", " ", "​ ​"]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["class"], r["n_links"]) for r in lookalike.alike_classes(df).collect()}
    assert got == {0: (0, 2), 1: (0, 3), 2: (0, 2), 3: (0, 3), 4: (4, 0), 6: (6, 2), 7: (6, 2), 8: (6, 2)}
    pairs = {tuple(r) for r in lookalike.alike_pairs(df, block=1).collect()}
    assert pairs == {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3), (6, 7), (6, 8), (7, 8)}
