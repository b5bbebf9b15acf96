import random

import pytest

from knotwork.llm import leakage

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string, doc_id string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def spans(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return leakage.leaked_spans(d, q, **options), d


def brute(docs, items, n=60):
    out = set()
    for i, t in docs:
        s = "".join(c for c in t.lower() if c.isalnum())
        for j, q in items:
            p = "".join(c for c in q.lower() if c.isalnum())
            if any(p[k : k + n] in s for k in range(len(p) - n + 1)):
                out.add((i, j))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, words(rng, 40)) for i in range(12)]
    docs = []
    for i in range(60):
        text = words(rng, 60)
        if i % 2:
            q = items[i % 12][1]
            a = rng.randint(0, len(q) - 20)
            piece = q[a : a + rng.randint(40, 160)]
            text = text[:100] + "; " + (piece.upper() if i % 3 else piece.replace(" ", " -\n")) + " " + text[100:]
        docs.append((i, text))
    want = brute(docs, items)
    assert want
    for max_bytes in (1 << 26, 3000):
        found, _ = spans(spark, docs, items, max_bytes=max_bytes)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_look_alikes_and_removal(spark):
    rng = random.Random(5)
    q = words(rng, 25)
    disguised = q.replace("a", "а").replace("o", "о").replace(" ", " ")
    found, d = spans(spark, [(1, "before. " + disguised + " .after"), (2, "nothing here"), (3, None)], [(7, q)])
    row = found.collect()
    assert [(r["doc_id"], r["item_id"]) for r in row] == [(1, 7)]
    assert row[0]["start"] == 8 and row[0]["stop"] == 8 + len(disguised)
    clean = {r["doc_id"]: r["text"] for r in leakage.without_leaks(d, found).collect()}
    assert clean == {1: "before.  .after", 2: "nothing here", 3: None}


def test_nulls_short_and_empty(spark):
    found, _ = spans(spark, [(1, None), (None, "x" * 80), (2, ""), (3, "short")], [(1, None), (2, "short"), (None, "x" * 80)])
    assert found.count() == 0
    empty = leakage.leaked_spans(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS))
    assert empty.count() == 0


@pytest.mark.parametrize("text", [
    "Plain text, with words.", "näive ӓ ﬁne", "คำ ที่ น้ำ เเละ", "r​n and v​v vv", "각 han", "ẹ́x", "", "  ", "x" * 300 + "rn" * 50,
])
def test_places_belong_to_the_stream(text):
    cp, starts, ends = leakage.traced(text)
    assert len(cp) == len(starts) == len(ends) and (cp == leakage.stream(text)).all()
    assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends, strict=True)) and (starts[1:] >= starts[:-1]).all()


def test_spans_of_texts_that_read_otherwise_letter_by_letter(spark):
    passage = "น้ำในแม่น้ำ and a passage of sixty letters that stands in the held out items of the suite"
    inside = passage.replace("น้ำ", "นํ้า")
    docs = spark.createDataFrame([(1, f"before {inside} after")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    spans = leakage.leaked_spans(docs, items)
    left = leakage.without_leaks(docs, spans).first()["text"]
    assert left.startswith("before ") and left.endswith(" after") and "sixty" not in left and "suite" not in left
