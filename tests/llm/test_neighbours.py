import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, cosine double, x string"


def vectors(n=300, seed=3, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dim))
    m = np.repeat(centres, 10, axis=0)[:n] + 0.2 * rng.normal(size=(n, dim))
    return [(int(i), [float(v) for v in r], 0.0, "") for i, r in enumerate(m.astype(np.float32))]


def brute(rows, k, least=-2.0):
    ids = [r[0] for r in rows]
    m = np.array([r[1] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = m @ m.T
    out = set()
    for i, a in enumerate(ids):
        best = sorted(((-c[i, j], b) for j, b in enumerate(ids) if b != a))[:k]
        out |= {(a, b) for s, b in best if -s >= least}
    return out


def found(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def test_single_cell_is_exact(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(neighbours.similar_vectors(df, 3, 0.8, dim=8, cell_rows=1000)) == brute(rows, 3, 0.8)
    assert found(neighbours.similar_vectors(df, 3, None, dim=8, cell_rows=1000)) == brute(rows, 3)


def test_blocks_of_a_large_cell_are_exact(spark):
    rows = vectors(120)
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.similar_vectors(df, 3, 0.7, dim=8, cell_rows=1000, block_rows=25)
    assert found(got) == brute(rows, 3, 0.7)


def test_recall_with_many_cells(spark):
    rows = vectors(2000, dim=16)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 3, 0.8)
    got = found(neighbours.similar_vectors(df, 3, 0.8, dim=16, cell_rows=64))
    assert len(got & want) / len(want) > 0.95


def test_recall_where_cells_are_divided_by_directions(spark):
    rows = vectors(2000, dim=16)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 3, 0.8)
    got = found(neighbours.similar_vectors(df, 3, 0.8, dim=16, cell_rows=64, max_cells=8))
    assert len(got & want) / len(want) > 0.95
    split = neighbours.similar_vectors(df, 3, 0.8, dim=16, cell_rows=64, max_cells=8, block_rows=40)
    assert found(split) == got


def test_queries_against_all_rows(spark):
    rows = vectors(200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.similar_to_queries(df, F.col("vec_id") % 20 == 0, 4, dim=8, block_rows=64)
    assert found(got) == {(a, b) for a, b in brute(rows, 4) if a % 20 == 0}


def test_unusable_repeated_and_copied_vectors(spark):
    rows = [(i, [1.0, 0.0], 0.0, "") for i in range(20)] + [(3, [1.0, 0.0], 0.0, "again")]
    bad = [(50, None, 0.0, ""), (51, [], 0.0, ""), (52, [0.0, 0.0], 0.0, ""), (53, [float("nan"), 1.0], 0.0, ""),
           (54, [1.0], 0.0, ""), (55, [None, 1.0], 0.0, ""), (None, [1.0, 0.0], 0.0, ""), (56, [float("inf"), 1.0], 0.0, "")]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    got = neighbours.similar_vectors(df, 2, 0.8, dim=2)
    assert found(got) == brute(rows[:20], 2)
    assert got.count() == 40


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours.similar_vectors(df, 2, 0.8, dim=2).count() == 0
    assert neighbours.similar_to_queries(df, F.col("vec_id") % 20 == 0, 2, dim=2).count() == 0


@pytest.mark.parametrize("dim", [4, 64])
def test_quantisation_keeps_the_cosine(dim):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, dim)).astype(np.float32)
    codes, scales = neighbours.quantise(m)
    x = codes * scales[:, None].astype(np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert np.abs(x @ x.T - u @ u.T).max() < 1e-4


def test_doubtful_places_are_settled_by_the_float_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 16))
    m = (base + rng.normal(size=(40, 16)) * 1e-5).astype(np.float32)  # cosines closer than the codes can tell
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(40)], "vec_id long, embedding array<float>")
    unit = m.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    merged = neighbours.merged_lists(
        spark.createDataFrame([(1, [2, 3], [0.9, 0.8]), (1, [4, 2], [0.85, 0.9]), (5, [6], [0.7])], neighbours.LISTS), 2, 1e-4, None
    )
    got = {r["x"]: (r["ys"], r["sure"]) for r in merged.collect()}
    assert got == {1: ([2, 4, 3], True), 5: ([6], True)}
    close = spark.createDataFrame([(1, [2, 3, 4], [0.9, 0.8, 0.79995])], neighbours.LISTS)
    assert [r["sure"] for r in neighbours.merged_lists(close, 2, 1e-4).collect()] == [False]
    candidates = spark.createDataFrame([(i, [int(j) for j in range(40) if j != i], [1.0] * 39, False) for i in range(40)], neighbours.MERGED)
    best = {(r["x"], r["rank"]): r["y"] for r in neighbours.settled(candidates, df, 3, None).collect()}
    assert best == {(i, n): int(j) for i in range(40) for n, j in enumerate(np.lexsort((np.arange(40), -s[i]))[:3], 1)}


def test_the_sample_of_the_fit_stays_off_the_driver(spark, monkeypatch):
    rows = vectors(500, dim=16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    codes, scales = neighbours.quantise(np.array([r[1] for r in rows], dtype=np.float32))
    want = neighbours.fitted(codes, scales, 2, 8, 2, 2, 7)
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("gathered on the driver"))
    coarse, fine, cells, expected = neighbours.fit_cells(df, len(rows), 16, 2, 40, 2, max_cells=8)
    assert all(np.array_equal(a, b) for a, b in zip((coarse, fine, cells, expected), want, strict=True))
    large = neighbours.fit_cells(df, len(rows), 16, 2, 40, 2, max_cells=8, above=100)
    assert set(zip(*large[2:], strict=True)) == {(c, n) for c, n in zip(cells, expected, strict=True) if n > 100}


def test_the_fit_holds_few_products_at_once():
    codes, scales = neighbours.quantise(np.random.default_rng(5).normal(size=(9000, 8)))
    tracemalloc.start()
    neighbours.fitted(codes, scales, 1, 4096, 2, 2, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
