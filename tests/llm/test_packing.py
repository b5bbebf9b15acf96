import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from knotwork.llm import packing

DOCS = "doc_id long, text string, tokens string"
WINDOWS = "window_name string, capacity_tokens int, doc_id string"


def run(spark, docs, windows):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    w = spark.createDataFrame([(n, c, "x") for n, c in windows], WINDOWS)
    return packing.packed(d, w), w


def test_windows_hold_their_capacity_and_every_token(spark):
    docs = [(i, "word " * (i % 37 * 7)) for i in range(400)] + [(400, None), (401, "")]
    pieces, w = run(spark, docs, [("small", 100), ("large", 1000), ("bad", 0), (None, 5)])
    rows = pieces.collect()
    sizes = {i: len(packing.encoder(None).encode_ordinary(t or "")) for i, t in docs}
    for name, room in (("small", 100), ("large", 1000)):
        mine = [r for r in rows if r["window_name"] == name]
        load, of = {}, {}
        for r in mine:
            load[r["window_id"]] = load.get(r["window_id"], 0) + r["tokens"]
            of.setdefault(r["doc_id"], []).append(r)
        assert max(load.values()) <= room
        assert {i: sum(r["tokens"] for r in rs) for i, rs in of.items()} == sizes
        assert all(len(rs) == 1 for i, rs in of.items() if sizes[i] <= room)
    used = {r["window_name"]: r["used"] for r in packing.fill(pieces, w).collect()}
    assert set(used) == {"small", "large"} and min(used.values()) > 0.85


def test_repeats_nulls_and_empty(spark):
    pieces, _ = run(spark, [(1, "a b c"), (1, "a b c"), (None, "x")], [("w", 10)])
    assert [(r["doc_id"], r["piece"]) for r in pieces.collect()] == [(1, 0)]
    assert run(spark, [], [("w", 10)])[0].count() == 0
    assert run(spark, [(1, "a")], [])[0].count() == 0


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        cells = np.stack([a.ravel() for a in axes], axis=1)
        order = np.argsort(packing.hilbert_key(cells, bits))
        assert len(set(packing.hilbert_key(cells, bits).tolist())) == len(cells)
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit_never_overfills(sizes):
    bins = packing.best_fit(sizes, 50)
    load = {}
    for s, b in zip(sizes, bins, strict=True):
        load[b] = load.get(b, 0) + s
    assert all(v <= 50 for v in load.values())
