import hashlib
import json
import math
import os
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.functions import vectors as V
from knotwork.operators import edges as E
from knotwork.operators import extract, graph, relate, resolve, retrieval, rules
from knotwork.runtime import staged, unstage

MENTIONS = "document_id string, text string, type string, start_pos int, end_pos int"
# Mentions whose relations are known.
ENTITIES = [
    ("d", "John Smith", "PERSON", 5, 15), ("d", "Acme Corporation", "ORGANIZATION", 26, 42), ("d", "New York City", "LOCATION", 83, 96),
    ("d", "Stanford University", "ORGANIZATION", 127, 147), ("d", "2010", "DATE", 151, 155), ("d", "Sarah Johnson", "PERSON", 161, 174),
]
DOCS = "document_id string, text string"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()["r"]


def test_ids(spark):
    assert one(spark, X.node_id(F.lit("John Smith"), F.lit("PERSON"))) == "1f188ddf44509975812dc5edca7d25b9"
    assert one(spark, X.uuid5(F.lit("doc1_0"))) == "e149b2b7-3f07-5219-9b73-1d59962ec908"
    rows = spark.range(200).select(F.concat_ws("_", F.lit("ทด"), F.col("id")).alias("s")).select("s", X.uuid5(F.col("s")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.UUID(int=0), r["s"])) for r in rows)


def test_rule_extraction(spark):
    text = "Grace Hopper joined Big Iron Works Corp on March 3rd, 1944 for $2,500.75 or 90 baht. Write to g.hopper@navy.example.org"
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "  "), ("g", "")], DOCS)
    got = {(r["type"], r["text"]) for r in extract.rule_mentions(df).collect()}
    assert got == {
        ("PERSON", "Grace Hopper"), ("PERSON", "Big Iron"), ("PERSON", "Works Corp"), ("ORGANIZATION", "Big Iron Works Corp"),
        ("DATE", "March 3rd, 1944"), ("MONEY", "$2,500.75"), ("MONEY", "90 baht"),
    }
    assert all(text[r["start_pos"] : r["end_pos"]] == r["text"] for r in extract.rule_mentions(df).collect())
    mail = extract.rule_mentions(df, ("EMAIL", "CONCEPT")).collect()
    assert [r["text"] for r in mail] == ["g.hopper@navy.example.org"]
    with pytest.raises(ValueError):
        extract.extract(df, "unheard of")


@pytest.mark.parametrize("kind, text, found", [
    ("PERSON", "Ada\n Byron Ann-Marie Lee McX Ab Cd_e ดร.Alan Turing, José Gray", ["Ada\n Byron", "Marie Lee", "Alan Turing"]),
    ("ORGANIZATION", "Acme Corp, Big Iron  Co Ltd and The Old Mill Company", ["Big Iron  Co Ltd", "The Old Mill Company"]),
    ("DATE", "May  4,\t2021 12/3/20 1/2/20201 3/4/2020x Juni 4, 2020", ["May  4,\t2021", "12/3/20"]),
    ("TIME", "10:30 pm, 9:05, 7:00x 123:45 8:15AM 10:30 and", ["10:30 pm", "9:05", "8:15AM", "10:30"]),
    ("MONEY", "$5 $1,000.50, 1,000 THB 3.5 dollars 7 dollar 5,5  baht", ["$5", "$1,000.50", "1,000 THB", "3.5 dollars", "5,5  baht"]),
    ("EMAIL", ".a.b@c.de x@y z@w.c1 m@n.o.pq- _u@v.com", ["a.b@c.de", "m@n.o.pq", "_u@v.com"]),
    ("PHONE", "(555) 123-4567 +66 812 345 6789 1.555.123.4567 5551234567 a555 123 4567 555 123 45678", ["(555) 123-4567", "+66 812 345 6789", "1.555.123.4567", "5551234567"]),
    ("URL", "http://a.b/c?d=1 https://www.x_y.com:80/p(q) http://bad ftp://a.b", ["http://a.b/c?d=1", "https://www.x_y.com:80/p(q)"]),
])
def test_rules(kind, text, found):
    assert [text[a:b] for _, a, b in rules.find_all(text, (kind,))] == found


def test_rules_read_long_texts_to_the_end(spark):
    part = "“Ada Byron” met Grace Hopper at 10:30 pm,  paid $1,000.50 on May 3, 2021. Call (555) 123 4567.\nดร.Alan Turing wrote a.b@c.org; Big Blue Iron Co? "
    texts = [part * 400, "ก" * 25_000 + " Anna Ng", "Xy " * 9_000, "no end, " * 3_000 + "12/3/2020"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], DOCS)
    got = extract.rule_mentions(df, tuple(rules.MATCHERS)).collect()
    one = rules.find_all(part, tuple(rules.MATCHERS))
    want = {("0", k, a + n * len(part), b + n * len(part)) for k, a, b in one for n in range(400)}
    assert {(r["document_id"], r["type"], r["start_pos"], r["end_pos"]) for r in got if r["document_id"] == "0"} == want
    assert all(texts[int(r["document_id"])][r["start_pos"] : r["end_pos"]] == r["text"] for r in got)
    assert [r["text"] for r in got if r["document_id"] in "13"] == ["Anna Ng", "12/3/2020"]
    assert sum(r["document_id"] == "2" for r in got) == 4_500


def test_model_is_asked_about_the_whole_text(spark):
    text = "x" * 190 + " Ada " + "y" * 300 + " Bob " + "z" * 300 + " Ada"
    df = spark.createDataFrame([("d", text)], DOCS)

    def ask(prompt):
        body = prompt.split("Text:\n")[1]
        return json.dumps([{"text": m.group(), "type": "PERSON", "start_pos": m.start(), "end_pos": m.end()} for m in re.finditer("Ada|Bob", body)])

    got = sorted((r["start_pos"], r["text"]) for r in extract.model_mentions(df, ask, chars=400).collect())
    assert got == [(m.start(), m.group()) for m in re.finditer("Ada|Bob", text)]


def test_gazetteer(spark):
    df = spark.createDataFrame([("d", "graph graphs"), ("e", None)], DOCS)
    long = "x" * 90 + "ที่" * 90
    df = df.union(spark.createDataFrame([("f", "ab" + long + "c"), ("g", "")], DOCS))
    terms = spark.createDataFrame([("graph", "CONCEPT"), ("", "CONCEPT"), ("raph", "X"), ("graphs", "X"), (None, "X"), (long, "L"), (long + "y", "L"), ("c", "C")], "text string, type string")
    for most in (1, 100):
        got = {(r["document_id"], r["text"], r["start_pos"], r["end_pos"]) for r in extract.gazetteer_mentions(df, terms, most_anchors=most).collect()}
        assert got == {
            ("d", "graph", 0, 5), ("d", "graph", 6, 11), ("d", "raph", 1, 5), ("d", "raph", 7, 11), ("d", "graphs", 6, 12), ("f", long, 2, 362), ("f", "c", 362, 363),
        }


def test_model_plugins(spark):
    reply = 'Here: [{"text": "John Smith", "type": "PERSON", "start_pos": 0, "end_pos": 10}, {"text": "x"}] done'
    df = spark.createDataFrame([("d", "John Smith"), ("e", "boom")], DOCS)

    def ask(prompt):
        if "boom" in prompt:
            raise RuntimeError
        return reply

    assert [(r["document_id"], r["text"], r["end_pos"]) for r in extract.model_mentions(df, ask).collect()] == [("d", "John Smith", 10)]
    m = spark.createDataFrame(ENTITIES[:3], MENTIONS)
    batches = relate.pair_batches(m, 2)
    assert sorted(r["n"] for r in batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()) == [1, 2]
    answer = '[{"source": "a", "target": "b", "relationship": "R", "confidence": 0.9}, {"source": "a", "target": "c", "relationship": "R"}]'
    assert {(r["target"]) for r in relate.model_relations(batches, lambda _: answer).collect()} == {"b"}


def test_proximity(spark):
    got = {(r["source"], r["target"], r["relationship"], r["distance"], round(r["confidence"], 2)) for r in relate.proximity(spark.createDataFrame(ENTITIES, MENTIONS)).collect()}
    assert got == {
        ("John Smith", "Acme Corporation", "WORKS_FOR", 11, 0.78), ("Acme Corporation", "New York City", "HEADQUARTERED_IN", 41, 0.5),
        ("Stanford University", "Sarah Johnson", "EMPLOYS", 14, 0.72),
    }


def test_proximity_equals_all_pairs_over_buckets(spark):
    rows = [("d", f"p{i}", "PERSON" if i % 2 else "ORGANIZATION", i * 37, i * 37 + (600 if i == 3 else 5)) for i in range(60)]
    got = {(r["source"], r["target"]) for r in relate.proximity(spark.createDataFrame(rows, MENTIONS)).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[3] < b[3] and b[3] - a[4] <= 50 and a[2] != b[2]}
    assert got == want


def test_phrases():
    table = relate.phrase_table()
    assert relate.phrase_hits("Ann works\n for Bo. Bo is an employee of Cy works at Di", table) == [
        ("WORKS_FOR", "Ann", "Bo", "Ann works\n for Bo"), ("WORKS_FOR", "Bo", "Cy", "Bo is an employee of Cy"), ("WORKS_FOR", "Cy", "Di", "Cy works at Di"),
    ]
    assert relate.phrase_hits("A joined B joined C", table) == [("WORKS_FOR", "A", "B", "A joined B")]
    assert relate.phrase_hits("joined B. A joined. was held in", table) == []


def test_rule_relations(spark):
    df = spark.createDataFrame([("d", "As John Smith works for Acme Corporation, he never saw New York City."), ("e", None)], DOCS)
    got = relate.rule_relations(df, spark.createDataFrame(ENTITIES, MENTIONS)).collect()
    assert [(r["source"], r["relationship"], r["target"], r["matched"]) for r in got] == [("John Smith", "WORKS_FOR", "Acme Corporation", "Smith works for Acme")]


def test_cooccurrence(spark):
    df = spark.createDataFrame([("d", "A knows B. A and B meet. C alone. B too. ")], DOCS)
    e = spark.createDataFrame([("d", x, "T") for x in ("A", "B", "C")], "document_id string, text string, type string")
    got = relate.cooccurrence(df, e, 0.5).collect()
    assert [(r["source"], r["target"], r["common_segments"], round(r["confidence"], 4)) for r in got] == [("A", "B", 2, 0.6667)]


def test_trigrams(spark):
    for a, b, want in (("john smith", "john smith jr.", 0.6667), ("john smith", "john smithson", 0.7273), ("nation_1", "nation_10", 0.8571)):
        assert round(one(spark, X.trigram_jaccard(F.lit(a), F.lit(b))), 4) == want
    t = spark.createDataFrame([("nation_1", "L"), ("nation_10", "L"), ("nation_2", "L"), ("nation_10", "X")], "text string, type string")
    assert [(r["short"], r["long"]) for r in resolve.near_duplicates(t).collect()] == [("nation_1", "nation_10")]


def test_chunker(spark):
    assert X.chunk_spans(2500, "a" * 2500, 1000, 200) == [(0, 1000), (800, 1800), (1600, 2500)]
    assert len(X.chunk_spans(2500, "a" * 2500, 1000, 200, "every_start")) == 203
    text = "One sentence. " * 200 + "\n\n" + "word " * 300
    spans = X.chunk_spans(len(text), text, 1000, 200)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", " short "), ("d", text)], DOCS)
    rows = {r["document_id"]: r["c"] for r in df.select("document_id", X.chunks(F.col("text")).alias("c")).collect()}
    assert rows["a"] == [] and rows["b"] == [] and rows["c"][0]["content"] == " short " and len(rows["d"]) == len(spans)


def edges_of(spark, rows):
    return spark.createDataFrame(
        [(hashlib.md5(f"{s}_{t}_{k}".encode()).hexdigest(), s, t, k, c, 1, ["d1"], b) for s, t, k, c, b in rows],
        "edge_id string, source_id string, target_id string, type string, confidence double, occurrences long, documents array<string>, bidirectional boolean",
    )


def nodes_of(spark, rows):
    return spark.createDataFrame([(i, t, k, 1, ["d1"]) for i, t, k in rows], "node_id string, text string, type string, occurrences long, documents array<string>")


def test_edges(spark):
    e = edges_of(spark, [("a", "b", "WORKS_FOR", 0.9, True), ("a", "c", "RELATED_TO", 0.4, True)])
    inv = E.with_inverse(e).collect()
    assert {(r["source_id"], r["target_id"], r["type"]) for r in inv} == {("a", "b", "WORKS_FOR"), ("b", "a", "EMPLOYS"), ("a", "c", "RELATED_TO")}
    assert E.confident(e, 0.5).count() == 1
    two = e.unionByName(e.withColumn("confidence", F.lit(0.95)).withColumn("documents", F.array(F.lit("d2"))))
    up = {r["source_id"] + r["target_id"]: r for r in E.upsert_edges(two).collect()}
    assert up["ab"]["occurrences"] == 2 and up["ab"]["confidence"] == 0.95 and up["ab"]["documents"] == ["d1", "d2"]
    n = nodes_of(spark, [("a", "John", "PERSON"), ("b", "Acme", "ORGANIZATION")])
    rel = spark.createDataFrame(
        [("john", "PERSON", "ACME", "ORGANIZATION", "WORKS_FOR", 0.9, False, "d"), ("john", "PERSON", "nobody", "PERSON", "KNOWS", 0.9, False, "d"),
         ("john", "PERSON", "acme", "ORGANIZATION", "KNOWS", 0.1, False, "d"), ("john", "PERSON", "John", "PERSON", "KNOWS", None, False, "d")],
        "source string, source_type string, target string, target_type string, relationship string, confidence double, bidirectional boolean, document_id string",
    )
    assert [(r["source_id"], r["target_id"]) for r in E.build_edges(rel, n).collect()] == [("a", "b")]


def test_graph(spark):
    n = nodes_of(spark, [(x, x.upper(), "T") for x in "abcdef"])
    e = edges_of(spark, [("a", "b", "R", 0.9, False), ("c", "b", "R", 0.9, False), ("c", "d", "R", 0.9, False), ("a", "d", "R", 0.2, False), ("d", "e", "R", 0.9, False)])
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "e"), ("a", "f")], "source string, target string")
    got = {(r["source"], r["target"]): (r["hops"], r["nodes"], len(r["edge_ids"])) for r in graph.shortest_paths(e, pairs, 3, 0.5).collect()}
    assert got == {("a", "d"): (3, ["a", "b", "c", "d"], 3)}
    assert graph.shortest_paths(e, pairs, 3).where("target = 'd'").first()["nodes"] == ["a", "d"]
    far = {r["target"]: r["nodes"] for r in graph.shortest_paths(e, pairs, 4, 0.5).collect()}
    assert far == {"d": ["a", "b", "c", "d"], "e": ["a", "b", "c", "d", "e"]} and graph.shortest_paths(e, pairs, 1, 0.5).count() == 0
    simple = {tuple(r["nodes"]) for r in graph.simple_paths(e, pairs.selectExpr("source as node_id"), pairs.selectExpr("target as node_id"), 3).collect()}
    assert simple == {("a", "d"), ("a", "b", "c", "d"), ("a", "d", "e")}
    near, inside = graph.ego_network(e, n, spark.createDataFrame([("a",)], "node_id string"), 2, 0.5, 2)
    assert {(r["node_id"], r["hop"]) for r in near.collect()} == {("a", 0), ("b", 1)} and inside.count() == 1
    s = {r["metric"]: r["value"] for r in graph.statistics(n, e).collect()}
    assert s["nodes"] == 6 and s["edges"] == 5 and round(s["average_degree"], 4) == round(10 / 6, 4)


def test_ego_network_at_a_hub(spark):
    """Every second leaf of a hub is a centre: no edge may be looked up in all the networks that hold the hub."""
    leaves = [f"n{i:03}" for i in range(120)]
    pairs = [("hub", x) for x in leaves] + [(leaves[i], leaves[i + 1]) for i in range(0, 120, 3)] + [(leaves[i], "hub") for i in range(5)] + [("n001", "n001")]
    e = edges_of(spark, [(a, b, "R", 0.9, False) for a, b in pairs])
    n = nodes_of(spark, [(x, x.upper(), "T") for x in ["hub", *leaves]])
    centres = leaves[::2]
    near, inside = graph.ego_network(e, n, spark.createDataFrame([(x,) for x in centres], "node_id string"), 2, 0.5, 10)
    beside = {x: sorted({b for a, b in pairs if a == x} | {a for a, b in pairs if b == x}) for x in ["hub", *leaves]}
    want = {}
    for c in centres:
        hop = {c: 0}
        for h in (1, 2):
            for x in [v for v, k in hop.items() if k == h - 1]:
                for y in beside[x]:
                    hop.setdefault(y, h)
        want[c] = dict(sorted(hop.items(), key=lambda x: (x[1], x[0]))[:10])
    got = near.select("start", "node_id", "hop").collect()
    assert sorted((r["start"], r["node_id"], r["hop"]) for r in got) == sorted((c, v, h) for c, w in want.items() for v, h in w.items())
    edges = sorted((r["start"], r["source_id"], r["target_id"]) for r in inside.collect())
    assert edges == sorted((c, a, b) for c, w in want.items() for a, b in pairs if a in w and b in w)
    few = near.select("start", "node_id")
    looked_up = graph.keyed_edges(e, few).join(few.withColumnRenamed("node_id", "key"), "key").count()
    assert looked_up <= 2 * len(edges) < sum(len(beside["hub"]) for _ in centres)


def test_lean_staging_leaves_no_shuffle_files(spark):
    shuffled = spark.range(1000).selectExpr("id", "id % 7 as k").groupBy("k").count()
    managers = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return set(re.findall(r"shuffle_\w+", managers.getAllBlocks().mkString(" ")))

    before = files()
    shuffled.collect()
    assert files() - before
    before = files()
    kept = staged(shuffled, "lean", lean=True)
    assert not files() - before and kept.count() == 7
    unstage(kept)
    assert not os.path.exists(kept._staged_at.removeprefix("file://"))


def test_links(spark):
    n = spark.createDataFrame([("n", [("d", p, p + 1) for p in (0, 799, 800, 1799, 1800)])], "node_id string, contexts array<struct<document string, start_pos int, end_pos int>>")
    c = spark.createDataFrame([("d", i) for i in range(3)], "document_id string, chunk_index int")
    assert sorted(r["chunk_index"] for r in graph.entity_chunk_links(n, c).collect()) == [0, 1, 2]
    assert sorted(r["chunk_index"] for r in graph.entity_chunk_links(n, c.where("chunk_index < 2")).collect()) == [0, 1]


def test_merge_and_components(spark):
    n = nodes_of(spark, [("a", "A", "T"), ("b", "B", "T"), ("c", "C", "T")])
    e = edges_of(spark, [("a", "b", "R", 0.9, False), ("b", "c", "R", 0.9, False), ("a", "c", "R", 0.8, False)])
    merged, edges = resolve.merge_nodes(n, e, spark.createDataFrame([("b", "a"), ("c", "c")], "alias string, primary string"))
    assert {(r["node_id"], r["occurrences"]) for r in merged.collect()} == {("a", 2), ("c", 1)}
    assert [(r["source_id"], r["target_id"], r["occurrences"]) for r in edges.collect()] == [("a", "c", 2)]
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y")], "a string, b string")
    roots = {r["id"]: r["root"] for r in resolve.components(links).collect()}
    assert set(roots.values()) == {"000", "x"} and len(roots) == 43


def test_vectors(spark):
    zero, a, b = (F.array(*[F.lit(float(x)) for x in v]) for v in ((0, 0), (1, 0), (-1, 0)))
    assert one(spark, V.cosine(zero, a)) == 0.0 and one(spark, V.cosine(a, b)) == -1.0 and one(spark, V.cosine(a, b, clip=True)) == 0.0
    assert one(spark, V.normalised(zero)) == [0.0, 0.0]
    df = spark.createDataFrame([("d", "alpha beta"), ("e", None), ("f", "")], DOCS).select(V.embedded(F.col("text")).alias("v")).collect()
    assert [r["v"] is None for r in df] == [False, True, True] and abs(sum(x * x for x in df[0]["v"]) - 1) < 1e-9
    calls = spark.createDataFrame([("d", "x")], DOCS).select(V.embedded(F.col("text"), lambda t: 1 / 0, tries=2, wait=0.0).alias("v")).collect()
    assert calls[0]["v"] is None


def test_fusion_and_filters(spark):
    near = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, id string, rank int")
    words = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query_id int, id string, rank int")
    assert [r["id"] for r in retrieval.fused(near, words).orderBy("rank").collect()] == ["b", "a", "c"]
    df = spark.createDataFrame([("text", 7), ("text", 3), ("pdf", 9)], "kind string, n int")
    assert df.where(X.where({"kind": "text", "n": {"GreaterThan": 5}})).count() == 1
    assert df.where(X.where({"kind": {"Like": "t*"}})).count() == 2 and df.where(X.where(None)).count() == 3


def brute_near(texts, threshold):
    def grams(t, n):
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    out = set()
    for a in texts:
        for b in texts:
            if a != b and len(a) < len(b) and a in b:
                n = 1 if len(a) < 3 else 3
                if len(grams(a, n)) / len(grams(b, n)) >= threshold:
                    out.add((a, b))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = ["ที่ทำงานกลาง", "ที่ทำงานกลางๆ", "straße der einheit", "straße der einheit 1", "aaaa", "aaaaa", "ab", "aba", "abc", "a", "aa", "großmann & söhne", "großmann & söhnes"]
    got = {(r["short"], r["long"]) for r in resolve.near_duplicates(spark.createDataFrame([(t, "T") for t in texts], "text string, type string")).collect()}
    assert got == brute_near(texts, 0.85)
    canonical = {r["text"]: r["canonical"] for r in resolve.canonical_near(spark.createDataFrame([(t, "T") for t in texts], "text string, type string")).collect()}
    assert canonical["aaaaa"] == "a" and canonical["großmann & söhnes"] == "großmann & söhne"


def test_vector_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(60, 4)), 1)
    v[7] = v[3]
    rows = [(i, v[i].tolist(), str(i % 2)) for i in range(60)] + [(60, None, "0"), (61, [1.0], "0"), (62, [float("nan")] * 4, "0")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, type string")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    for block in (7, 4096):
        q = df.where("id % 10 = 0 and id < 60").selectExpr("id as query_id", "embedding")
        got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.nearest(q, df, 3, 1, block_rows=block).collect()}
        want = {(i, r): int(j) for i in range(0, 60, 10) for r, j in enumerate(np.lexsort((np.arange(60), -s[i]))[1:4], 1)}
        assert got == want
        near = {(r["a"], r["b"]) for r in retrieval.similarity_edges(df, 0.5, block_rows=block).collect()}
        assert near == {(a, b) for a in range(60) for b in range(a + 1, 60) if s[a, b] > 0.5}
    dup = {(r["a"], r["b"]) for r in resolve.embedding_duplicates(df, 0.9).collect()}
    assert dup == {(a, b) for a in range(60) for b in range(a + 2, 60, 2) if s[a, b] >= 0.9}
    several = df.where("id < 60").selectExpr("id % 20 as id", "embedding")
    best = retrieval.nearest(several.where("id = 0").selectExpr("id as query_id", "embedding"), several, 20, block_rows=9).collect()
    groups = [[0, 20, 40]] + [[g, g + 20, g + 40] for g in range(1, 20)]
    assert {r["id"]: round(r["similarity"], 9) for r in best} == {g[0]: round(float(s[np.ix_([0, 20, 40], g)].max()), 9) for g in groups}


def test_keywords_equal_brute_force(spark):
    texts = ["red fish blue fish", "blue moon", "the red red moon", "", None, "the the the", "fish"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")
    q = spark.createDataFrame([(1, "Red fish"), (2, "the moon the"), (3, None), (4, "unheard")], "query_id int, text string")
    words = [(t or "").split() for t in texts]
    mean = sum(map(len, words)) / len(words)

    def score(query, w):
        total = 0.0
        for t in set(query):
            df = sum(t in x for x in words)
            if t in w:
                tf = w.count(t)
                total += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        return round(total, 6)

    want = {(n, f"d{i}"): score(query, w) for n, query in ((1, ["red", "fish"]), (2, ["the", "moon"])) for i, w in enumerate(words) if score(query, w)}
    for block in (2, 4096):
        got = retrieval.keyword_top(q, docs, 3, block_rows=block).collect()
        assert all(round(r["score"], 6) == want[(r["query_id"], r["id"])] for r in got) and {r["query_id"] for r in got} == {1, 2}
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1] == [k[1] for k in sorted((k for k in want if k[0] == 1), key=lambda k: (-want[k], k[1]))][:3]


def test_metadata_and_removals(spark):
    n = spark.createDataFrame(
        [("a", "A", "T", 1, ["d1"], [("d1", 0, 1)], '{"x": 1, "y": ["p", "q"]}'), ("b", "B", "T", 2, ["d2", None], None, '{"x": 2, "y": "p"}'), ("c", "C", "T", None, None, [("d3", 4, 5)], "cut {")],
        "node_id string, text string, type string, occurrences long, documents array<string>, contexts array<struct<document string, start_pos int, end_pos int>>, metadata string",
    )
    e = edges_of(spark, [("a", "b", "R", 0.9, False), ("b", "c", "R", None, False)]).withColumn("metadata", F.lit('{"k": "v"}'))
    merged, edges = resolve.merge_nodes(n, e, spark.createDataFrame([("b", "a")], "alias string, primary string"))
    rows = {r["node_id"]: r for r in merged.collect()}
    assert json.loads(rows["a"]["metadata"]) == {"x": ["1", "2"], "y": ["p", "q"]} and rows["a"]["documents"] == ["d1", "d2"]
    assert [tuple(c) for c in rows["a"]["contexts"]] == [("d1", 0, 1)] and rows["c"]["documents"] == [] and rows["c"]["metadata"] is None
    assert [(r["source_id"], json.loads(r["metadata"])) for r in edges.collect()] == [("a", {"k": ["v"]})]
    kept, gone = resolve.remove_nodes(n, e, spark.createDataFrame([("b",), (None,)], "node_id string"))
    assert sorted(r["node_id"] for r in kept.collect()) == ["a", "c"] and gone.count() == 0
    left, removed = E.remove_edges(e, e.limit(1).select("edge_id").unionByName(spark.createDataFrame([("none",)], "edge_id string")))
    assert left.count() == 1 and removed.first()["removed"] == 1
    assert tuple(E.confidence_cut(e, 0.5).first()) == (1, 1)
    m = spark.createDataFrame([("d1", "Acme", "O", 5, 9, '{"s": "x"}'), ("d0", "ACME", "O", 3, 7, '{"s": "y"}'), ("d1", "acme", "O", 1, 5, None)], MENTIONS + ", metadata string")
    up = resolve.upsert_nodes(m).first()
    assert (up["text"], up["occurrences"], up["documents"], json.loads(up["metadata"])) == ("ACME", 3, ["d0", "d1"], {"s": ["x", "y"]})
    assert [tuple(c) for c in up["contexts"]] == [("d0", 3, 7), ("d1", 1, 5), ("d1", 5, 9)]
    assert {r["node_id"] for r in resolve.mention_nodes(m).collect()} == {up["node_id"]}


def test_classes_stand_for_their_members(spark):
    n = spark.createDataFrame([(f"n{i:03d}", ["a", "b", None] if i < 40 else ["b", "c", "a"]) for i in range(80)] + [("x", ["a"]), ("y", None)], "node_id string, documents array<string>")
    for block in (1, 512):
        got = relate.cross_document(n, block=block).collect()
        assert [(r["node_a"], r["node_b"], r["common"], round(r["confidence"], 4)) for r in got] == [("n000", "n040", 2, 0.6667)]
    classes = {r["node_id"]: r["class"] for r in relate.document_classes(n).collect()}
    assert len(classes) == 81 and set(classes.values()) == {"n000", "n040", "x"}
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, None, 2), (5, None, 3)], "k int, u string, v int")
    assert {(r["a"], r["b"], r["shared_columns"]) for r in relate.row_similarity(rows, "k", ["u", "v"]).collect()} == {(1, 3, "u"), (3, 4, "v")}
    assert {r["key"]: r["class"] for r in relate.row_classes(rows, "k", ["u", "v"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
