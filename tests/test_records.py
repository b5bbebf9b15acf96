import datetime as dt
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from knotwork.operators import nested, orphans

T0 = dt.datetime(2024, 1, 1)
NODES = "node_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, edge_id string, ref string"
EDGES = "edge_id string, source_id string, target_id string, ingested_at timestamp_ntz, node_id string, ref string, t string"


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def judged(spark, nodes, edges, **options):
    n = spark.createDataFrame([(i, at(a), at(d), "x", "x") for i, a, d in nodes], NODES)
    e = spark.createDataFrame([(i, s, t, at(a), "x", "x", "x") for i, s, t, a in edges], EDGES)
    return {(r["edge_id"], r["ref_field"], r["reason"]) for r in orphans.orphan_references(e, n, **options).collect()}


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_orphans(spark, most):
    nodes = [("a", 0, None), ("b", 50, None), ("c", 0, None), ("c", 10, 20), ("c", 90, None), ("a", 0, None), (None, 0, None)]
    edges = [
        ("e1", "a", "zz", 5), ("e2", " A ", "b", 5), ("e3", "c", "c", 15), ("e4", "c", "C\t", 30), ("e5", None, "  ", 30),
        ("e6", "a", "b", 60), ("e7", "c", "a", 95), ("e8", "zz", "a", 10), ("e8", "a", "a", 20), ("e9", "zz", "b", None), (None, "zz", "zz", 1),
    ]
    assert judged(spark, nodes, edges, max_filter_bytes=most) == {
        ("e1", "target_id", "missing"), ("e2", "target_id", "late"), ("e4", "source_id", "deleted"), ("e4", "target_id", "deleted"),
        ("e8", "source_id", "missing"), ("e9", "source_id", "missing"),
    }


def test_orphans_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    nodes = [(f"n{rng.randint(0, 30) if rng.random() < .6 else 0}", rng.randint(0, 400), rng.choice([None, None, rng.randint(0, 500)])) for _ in range(150)]
    nodes = [(i, a + k / 1000, d) for k, (i, a, d) in enumerate(nodes)]
    edges = [(f"e{i}", f"n{rng.randint(0, 40)}", "n0", rng.randint(0, 500) + .5) for i in range(300)]
    want = set()
    for e, s, t, a in edges:
        for f, r in (("source_id", s), ("target_id", t)):
            before = [x for x in nodes if x[0] == r and x[1] <= a]
            last = max(before, key=lambda x: x[1]) if before else None
            if last is None or (last[2] is not None and last[2] <= a):
                want.add((e, f))
    assert {(e, f) for e, f, _ in judged(spark, nodes, edges)} == want


def test_empty_tables(spark):
    assert judged(spark, [], [("e", "a", "b", 1)]) == {("e", "source_id", "missing"), ("e", "target_id", "missing")}
    assert judged(spark, [("a", 0, None)], []) == set()


RECORDS = "node_id string, ingested_at timestamp_ntz, documents array<string>, contexts array<struct<document string, start_pos int, end_pos int>>, metadata string, path string"


def paths(spark, rows):
    df = spark.createDataFrame([(i, at(a), d, c, m, "x") for i, a, d, c, m in rows], RECORDS)
    return {(r["node_id"], r["path"]) for r in nested.element_paths(df).collect()}


def test_paths(spark):
    deep = {"a": {"b": [{"c": 1}, None, [{"d": {}}, []]]}, "e": json.dumps({"f": [{}]}), "g": "{cut"}
    rows = [
        ("n", 1, ["x", None, "y"], [("d", 1, 2), None], json.dumps(json.dumps(deep))), ("n", 0, ["old"], None, None),
        ("m", 1, None, [], "{\"cut\": {"), ("o", 1, [], None, " "), ("p", 1, None, None, "[{\"q\": {}}]"), (None, 1, ["x"], None, None), ("r", 1, None, None, "3"),
    ]
    assert paths(spark, rows) == {("n", p) for p in (
        "documents[0]", "documents[2]", "contexts[0]", "metadata.a", "metadata.a.b[0]", "metadata.a.b[2][0]", "metadata.a.b[2][0].d",
        "metadata.e", "metadata.e.f[0]",
    )} | {("p", "metadata[0]"), ("p", "metadata[0].q")}
    assert paths(spark, []) == set()


def test_depth_beyond_one_stage(spark):
    text = '{"a":' * 30 + "{}" + "}" * 30
    got = paths(spark, [("n", 1, None, None, text)])
    assert len(got) == 30 and ("n", "metadata" + ".a" * 30) in got


def test_child_tables_keep_their_parents(spark):
    text = json.dumps({"s": [{"k": 1, "t": [{"v": "x"}, {"v": "y"}]}, {"k": "2"}]})
    df = spark.createDataFrame([("n", text)], "node_id string, metadata string")
    decoded, depth = nested.decoded_records(df, "node_id", "metadata")
    objects = nested.child_records(decoded, "node_id", "metadata", depth)
    parents = {r["record_key"]: r for r in nested.child_table(objects, "node_id", "metadata.s[]", ["k"]).collect()}
    kids = nested.child_table(objects, "node_id", "metadata.s[].t[]", ["v"]).collect()
    assert {(r["ordinal"], r["v"], parents[r["parent_key"]]["k"]) for r in kids} == {(0, "x", "1"), (1, "y", "1")}
    schema = {(r["pattern"], r["field"]): r["types"] for r in nested.merged_schema(objects).collect()}
    assert schema[("metadata.s[]", "k")] == ["BIGINT", "STRING"]


def test_all_records_become_rows(spark):
    text = json.dumps({"c": 0.5, "m": ["a", None, 3], "t": [["x"], []], "s": [{"k": "v", "o": {}}]})
    df = spark.createDataFrame([("n", text), ("p", "[1, {}]"), ("q", "{}")], "node_id string, metadata string")
    decoded, depth = nested.decoded_records(df, "node_id", "metadata")
    rows = nested.child_records(decoded, "node_id", "metadata", depth)
    kids = nested.child_rows(rows, "node_id").collect()
    flat = {(r["node_id"], r["path"], r["ordinal"], r["field"]): r["value"] for r in kids if r["field"] not in ("m", "t", "s")}
    assert flat == {
        ("n", "metadata", None, "c"): "0.5", ("n", "metadata.m[0]", 0, None): "a", ("n", "metadata.m[2]", 2, None): "3",
        ("n", "metadata.t[0][0]", 0, None): "x", ("n", "metadata.s[0]", 0, "k"): "v", ("n", "metadata.s[0]", 0, "o"): None,
        ("n", "metadata.s[0].o", None, None): None, ("p", "metadata[0]", 0, None): "1", ("p", "metadata[1]", 1, None): None, ("q", "metadata", None, None): None,
    }
    keys = {r["path"]: r["record_key"] for r in kids if r["node_id"] == "n"}
    assert {r["parent_key"] for r in kids if r["path"] == "metadata"} == {None}
    assert {r["parent_key"] for r in kids if r["path"] in ("metadata.m[0]", "metadata.s[0]") and r["node_id"] == "n"} == {keys["metadata"]}
    schema = {(r["pattern"], r["field"]): r["types"] for r in nested.merged_schema(rows).collect()}
    assert schema[("metadata", "c")] == ["DECIMAL"] and schema[("metadata.m[]", None)] == ["BIGINT", "STRING"] and schema[("metadata.t[][]", None)] == ["STRING"]


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab{[\"", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


@given(JSON, st.integers(0, 3))
def test_decoding_undoes_any_number_of_encodings(value, times):
    text = json.dumps(value)
    for _ in range(times):
        text = json.dumps(text)
    assert nested.fragments(text, "m") == nested.fragments(json.dumps(value), "m")


@given(st.text("{}[],:\" a1\\", max_size=12) | JSON.map(json.dumps))
def test_the_reader_for_deep_texts_agrees_with_the_usual_one(text):
    def read(parse):
        try:
            return parse(text)
        except ValueError:
            return ValueError

    assert read(nested._parse_deep) == read(json.loads)


def test_numbers_that_no_double_holds_and_deep_records_keep_their_rows(spark):
    deep = '{"a":' * 5000 + '{"b": [1e999]}' + "}" * 5000
    very = '{"a":' * 20_000 + "{}" + "}" * 20_000
    huge = '{"x": {"n": 1e999}, "y": [{"n": ' + "9" * 5000 + "}]}"
    got = paths(spark, [("n", 1, None, None, deep), ("m", 1, None, None, huge), ("o", 1, None, None, deep[:-1])])
    assert {p for i, p in got if i == "m"} == {"metadata.x", "metadata.y[0]"} and not any(i == "o" for i, _ in got)
    assert {p for i, p in got if i == "n"} == {"metadata" + ".a" * k for k in range(1, 5001)}
    assert len(nested.fragments(very, "m")) == 313  # 20,001 levels, 64 in each


def test_fragments_of_deep_records_keep_paths_and_parents():
    found = nested.fragments('{"x": {"y": [[{"z": {}}], null]}}', "m", 2)
    assert found == [
        ("m", None, None, '{"x": {"y": null}}', 2), ("m.x.y", "m.x", None, "[[null], null]", 2), ("m.x.y[0][0]", "m.x", 0, '{"z": {}}', 2),
    ]
