"""The k most similar vectors of every vector, by a block matrix join.

Vectors are normalised and quantised to 16-bit codes whose high byte is an int8 code.
Rows meet in tiles; a tile multiplies the int8 codes (held as float32, so the products are
exact) and keeps the pairs whose cosine can reach the threshold within the proven
quantisation error; these are recomputed from the full codes, and the lists of all tiles
are merged by heaps. Where the error of the codes leaves open which are the k best, or
whether a cosine reaches the threshold, the float vectors decide.

Which rows share a tile is decided in one of two ways:

* ``similar_vectors``: ``tables`` independent clusterings, each fitted on a bounded sample
  (at most ``MAX_CELLS * SAMPLE_PER_CELL`` rows); every row is indexed in its ``probes``
  nearest cells of each, beyond ``MAX_CELLS * cell_rows`` rows in the ``probes`` nearest
  directions inside each of them. So cells keep their size and work grows with the rows;
  cells that still hold more than ``block_rows`` rows are split into blocks and all pairs of
  blocks are multiplied, so nothing is cut.
* ``similar_to_queries``: a stated query set against all rows in blocks, exact; the last
  candidates are ranked by the full vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.runtime import staged

MAX_CELLS = 4096
SAMPLE_PER_CELL = 32
SPARE = 3  # further candidates for which the full vectors decide
COPIES_KEPT = 1  # copies of one vector beyond k + COPIES_KEPT are linked without a product

CODED = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("scale", T.FloatType()),
])
MERGED = T.StructType([
    T.StructField("x", T.LongType()), T.StructField("ys", T.ArrayType(T.LongType())), T.StructField("cosines", T.ArrayType(T.FloatType())),
    T.StructField("sure", T.BooleanType()),
])
FITTED = T.StructType([T.StructField(c, T.BinaryType()) for c in ("coarse", "fine", "cells", "expected")])
LISTS = T.StructType([
    T.StructField("x", T.LongType()), T.StructField("ys", T.ArrayType(T.LongType())),
    T.StructField("cosines", T.ArrayType(T.FloatType())),
])


def usable(c: Column, dim: int) -> Column:
    """True for vectors of ``dim`` finite values that are not all zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) == dim) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes and scales of the unit vectors of the rows of ``m``."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    scale = np.abs(m).max(axis=1) / 32512.0  # 127 * 256: the high byte stays within int8
    return np.rint(m / scale[:, None]).astype("<i2"), scale.astype(np.float32)


def tile_neighbours(
    ids: np.ndarray, codes: np.ndarray, scales: np.ndarray, k: int, min_cosine: float | None,
    asks: np.ndarray | None = None, given: np.ndarray | None = None, rows_at_once: int = 512,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the k best of every asking row among the given rows of a tile.

    Without ``asks`` every row asks; with ``given`` only those rows are candidates. The int8
    product decides, with its error bound, which pairs are recomputed from the full codes.
    """
    exact = codes.astype(np.float32) * scales[:, None]
    coarse = np.rint(codes / 256.0).astype(np.float32)  # int8 values
    near = coarse * (scales[:, None] * np.float32(256.0))
    err = np.linalg.norm(exact - near, axis=1)
    slack = float(err.max() * (2 + err.max()) + 1e-5)
    rows = np.arange(len(ids)) if asks is None else np.flatnonzero(asks)
    cols = np.arange(len(ids)) if given is None else np.flatnonzero(given)
    right, out = near[cols].T.copy(), []
    by_id = np.argsort(ids[cols], kind="stable")
    own = by_id[np.minimum(np.searchsorted(ids[cols], ids[rows], sorter=by_id), max(0, len(cols) - 1))] if len(cols) else rows[:0]
    mine = ids[cols][own] == ids[rows] if len(cols) else np.zeros(len(rows), bool)
    for i in range(0, len(rows) if len(cols) else 0, rows_at_once):
        r = rows[i : i + rows_at_once]
        s = near[r] @ right
        self_at = np.flatnonzero(mine[i : i + rows_at_once])
        s[self_at, own[i : i + rows_at_once][self_at]] = -9.0
        hit = s >= np.float32(-1.5 if min_cosine is None else min_cosine - slack)
        if len(cols) > 4 * k and np.count_nonzero(hit) > 4 * k * len(r):
            kth = np.partition(s, len(cols) - k, axis=1)[:, len(cols) - k]
            hit &= s >= (kth - 2 * slack)[:, None]
        a, b = np.nonzero(hit)
        for j in range(0, len(a), 1 << 18):
            ra, cb = r[a[j : j + (1 << 18)]], cols[b[j : j + (1 << 18)]]
            out.append((ra, cb, np.einsum("ij,ij->i", exact[ra], exact[cb], dtype=np.float64)))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
    if min_cosine is not None:
        keep = c >= min_cosine
        a, b, c = a[keep], b[keep], c[keep]
    order = np.lexsort((ids[b], -c, a))
    a, b, c = a[order], b[order], c[order]
    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else np.empty(0, int)
    best = np.arange(len(a)) - start < k
    return a[best], b[best], c[best]


def _lists(ids: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """One row per asking vector with its candidates and cosines."""
    if not len(a):
        return pd.DataFrame([], columns=LISTS.fieldNames())
    cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return pd.DataFrame({
        "x": ids[a[cut]], "ys": np.split(ids[b], cut[1:]), "cosines": np.split(c.astype(np.float32), cut[1:]),
    })


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(pdf["code"]), dtype="<i2").reshape(len(pdf), -1)
    return pdf["vec_id"].to_numpy(), codes, pdf["scale"].to_numpy(np.float32)


def cosine_error(dim: int) -> float:
    """A bound of the error of a cosine of 16-bit codes: every coordinate is off by at most 1 / 65024."""
    return 2 * math.sqrt(dim) / 65024 + 1e-6


def merged_lists(lists: DataFrame, k: int, error: float, min_cosine: float | None = None) -> DataFrame:
    """(x, ys, cosines, sure): the best of the partial lists of every vector, merged by a heap, ties by smaller id.

    ``SPARE`` more than ``k`` are kept. ``sure``: no cosine of the first k can change its place
    with a later one, or pass ``min_cosine``, within the error.
    """
    def row(x: int, best: dict[int, float]) -> tuple:
        top = heapq.nsmallest(k + SPARE, best.items(), key=lambda e: (-e[1], e[0]))
        c = [e[1] for e in top]
        sure = len(c) <= k or c[k - 1] - c[k] > 2 * error
        if min_cosine is not None:
            sure = sure and all(abs(v - min_cosine) > error for v in c)
        return x, [e[0] for e in top], c, sure

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, best = None, {}
        for pdf in batches:
            out = []
            for x, ys, cosines in zip(pdf["x"].tolist(), pdf["ys"], pdf["cosines"], strict=True):
                if x != last:
                    if best:
                        out.append(row(last, best))
                    last, best = x, {}
                for y, c in zip(ys.tolist(), cosines.tolist(), strict=True):
                    if c > best.get(y, -9.0):
                        best[y] = c
            yield pd.DataFrame(out, columns=MERGED.fieldNames())
        if best:
            yield pd.DataFrame([row(last, best)], columns=MERGED.fieldNames())

    return lists.repartition("x").sortWithinPartitions("x").mapInPandas(merge, MERGED)


def settled(merged: DataFrame, rows: DataFrame, k: int, min_cosine: float | None, broadcast_rows: int = 200_000) -> DataFrame:
    """(x, y, cosine, rank): the k best of every list; where the codes leave a doubt, by the cosines of the float vectors."""
    merged = staged(merged, "merged")
    kept = F.arrays_zip("ys", "cosines")
    sure = merged.where("sure").select("x", F.posexplode(F.slice(kept, 1, k)).alias("rank", "e")).select(
        "x", F.col("e.ys").alias("y"), F.col("e.cosines").cast("double").alias("cosine"), (F.col("rank") + 1).alias("rank")
    )
    doubt = staged(merged.where("not sure").select("x", F.explode("ys").alias("y")), "doubt")
    ids = doubt.select(F.col("x").alias("vec_id")).unionByName(doubt.select(F.col("y").alias("vec_id"))).distinct()
    few = ids.count() <= broadcast_rows
    asked = rows.join(F.broadcast(ids) if few else ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    both = sure.unionByName(refined(doubt, asked, k))
    return both if min_cosine is None else both.where(F.col("cosine") >= min_cosine)


def refined(found: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best of (x, y) candidates by cosines of the full vectors, in double precision."""
    v = rows.select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("v"))

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)

    both = (
        found.select("x", "y").join(v.select(F.col("vec_id").alias("x"), F.col("v").alias("a")), "x")
        .join(v.select(F.col("vec_id").alias("y"), F.col("v").alias("b")), "y")
    )
    both = both.select("x", "y", (dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))).alias("cosine"))
    w = Window.partitionBy("x").orderBy(F.desc("cosine"), "y")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _coded(df: DataFrame) -> DataFrame:
    """(vec_id, code, scale) of usable vectors."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                codes, scales = quantise(np.stack(pdf["embedding"].to_numpy()))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "code": [c.tobytes() for c in codes], "scale": scales})

    return df.select("vec_id", "embedding").mapInPandas(code, CODED)


def single_rows(df: DataFrame, k: int, broadcast_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Usable rows without surplus copies, and (x, y, cosine) of the surplus copies.

    A vec_id with different vectors keeps the one of the smallest hash. Of the ids with one
    and the same vector only the k + 1 smallest take part in products: the others have the
    k smallest as their best and are, by the tie rule, in nobody's list. Only ids and hashes
    are shuffled; exact repeats of a row are left to the tiles, where they meet. The rows to
    leave out are staged and broadcast if they are at most ``broadcast_rows``, else joined.
    """
    both = ["g", "h"]
    df = df.select("*", F.xxhash64("embedding").alias("g"), F.hash("embedding").alias("h"))
    ids = df.select("vec_id", F.struct(*both).alias("v")).distinct()
    ids = ids.withColumn("own", F.min("v").over(Window.partitionBy("vec_id")))
    kept = ids.where(F.col("v") == F.col("own")).select("vec_id", "v")
    ranked = kept.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    least = ranked.where(F.col("n") <= k + COPIES_KEPT)
    hot = least.where(F.col("n") == k + COPIES_KEPT).select("v", F.col("vec_id").alias("last"))
    surplus = kept.join(hot, "v").where(F.col("vec_id") > F.col("last")).select("vec_id", "v", F.lit(True).alias("copy"))
    other = ids.where(F.col("v") != F.col("own")).select("vec_id", "v", F.lit(False).alias("copy"))
    drop = staged(surplus.unionByName(other).select("vec_id", "v.*", "copy"), "surplus")
    n_drop = drop.count()
    left_out = drop.select("vec_id", *both)
    rows = df.join(F.broadcast(left_out) if n_drop <= broadcast_rows else left_out, ["vec_id", *both], "left_anti")
    first = least.where(F.col("n") <= k).select("v.*", F.col("vec_id").alias("y"))
    links = drop.where("copy").select(F.col("vec_id").alias("x"), *both).join(first, both)
    links = links.select("x", "y", F.lit(1.0).alias("cosine"))
    if not n_drop:
        rows, links = df, links.limit(0)
    return rows.drop(*both), links


def nearest_cells(x: np.ndarray, centroids: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` nearest centroids of every row."""
    s = x @ centroids.T
    return np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(m), (len(x), 1))


def centred(part: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 3) -> np.ndarray:
    """``n`` centroids of spherical k-means over the unit vectors ``part``."""
    c = part[rng.permutation(len(part))[:n]].copy()
    if len(c) < n:
        c = np.resize(c, (n, part.shape[1]))
    step = rows_at_once(n)
    for _ in range(rounds):
        near = np.concatenate([(part[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(part), step)])
        total = np.zeros_like(c)
        np.add.at(total, near, part)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-9), c)
    return c.astype(np.float32)


def offsets(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The directions in which the rows lie from their centroids."""
    d = x - centre
    return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9)


def cells_of(x: np.ndarray, coarse: np.ndarray, fine: np.ndarray, probes: int) -> np.ndarray:
    """The cells of every row: its nearest coarse cells, in each of them the nearest directions."""
    near = nearest_cells(x, coarse, min(probes, len(coarse)))
    if len(fine) == 1:
        return near.astype(np.int64)
    m = min(probes, len(fine))
    return np.concatenate([c[:, None] * len(fine) + nearest_cells(offsets(x, coarse[c]), fine, m) for c in near.T.astype(np.int64)], axis=1)


def rows_at_once(n_cells: int) -> int:
    """Rows that are compared with all centroids at once: at most 4 million products are held."""
    return max(256, min(4096, (1 << 22) // max(1, n_cells)))


def fitted(
    codes: np.ndarray, scales: np.ndarray, tables: int, n_cells: int, n_fine: int, probes: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coarse and fine centroids of a sample, its cells (numbered over all tables) and how many of its rows they hold."""

    def floats(at: np.ndarray | slice) -> np.ndarray:
        return codes[at].astype(np.float32) * scales[at, None]

    step = rows_at_once(n_cells)
    rng, coarse, fine, cells, held = np.random.default_rng(seed), [], [], [], []
    for t in range(tables):
        part = floats(rng.permutation(len(codes))[: max(1, len(codes) // 2)])
        coarse.append(centred(part, n_cells, rng))
        if n_fine > 1:
            for i in range(0, len(part), step):
                x = part[i : i + step]
                part[i : i + step] = offsets(x, coarse[t][nearest_cells(x, coarse[t], 1)[:, 0]])
            fine.append(centred(part, n_fine, rng))
        else:
            fine.append(np.zeros((1, part.shape[1]), dtype=np.float32))
        near = [cells_of(floats(slice(i, i + step)), coarse[t], fine[t], probes) for i in range(0, len(codes), step)]
        c, n = np.unique(np.concatenate(near).ravel() + t * n_cells * n_fine, return_counts=True)
        cells.append(c)
        held.append(n)
    return np.stack(coarse), np.stack(fine), np.concatenate(cells), np.concatenate(held)


def fit_cells(
    rows: DataFrame, n_rows: int, dim: int, tables: int, cell_rows: int, probes: int, max_cells: int = MAX_CELLS, seed: int = 7, above: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coarse (tables, cells, dim) and fine (tables, directions, dim) centroids, fitted on a bounded sample.

    Up to ``max_cells * cell_rows`` rows there is one direction. Beyond, the coarse cells stay
    ``max_cells`` and each is divided by the directions of its rows from its centroid, which
    all cells of a table share; so cells keep their size up to ``max_cells`` squared cells.
    Also the cells (numbered over all tables) in which more than ``above`` rows are to be
    expected, and how many, by which large cells are split; the split only sets the size of
    the tiles, never what they find. The sample is gathered and fitted in one task; the driver
    gets the centroids and the large cells, never the sample.
    """
    n_cells = int(min(max_cells, max(1, math.ceil(n_rows / cell_rows))))
    n_fine = int(min(max_cells, max(1, math.ceil(n_rows / (cell_rows * max_cells)))))
    want = n_cells * SAMPLE_PER_CELL * 2
    share = min(1.0, 1.2 * want / max(1, n_rows))
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, n = [], 0
        for pdf in batches:
            if len(pdf) and n < want:
                got.append(_unpack(pdf.iloc[: want - n])[1:])
                n += len(got[-1][1])
        if not n:
            return
        codes, scales = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        coarse, fine, cells, held = fitted(codes, scales, tables, n_cells, n_fine, probes, seed)
        expected = np.ceil(held * (n_rows / n)).astype(np.int64)
        parts = [coarse, fine, cells[expected > above].astype(np.int64), expected[expected > above]]
        yield pd.DataFrame([[x.tobytes() for x in parts]], columns=FITTED.fieldNames())

    found = _coded(picked).repartition(1).sortWithinPartitions("vec_id").mapInPandas(fit, FITTED).collect()
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros((tables, 1, dim), dtype=np.float32), np.zeros((tables, 1, dim), dtype=np.float32), none, none
    coarse, fine = (np.frombuffer(found[0][x], dtype=np.float32).reshape(tables, -1, dim) for x in ("coarse", "fine"))
    return coarse, fine, np.frombuffer(found[0]["cells"], dtype=np.int64), np.frombuffer(found[0]["expected"], dtype=np.int64)


def similar_vectors(
    vectors: DataFrame,
    k: int = 5,
    min_cosine: float | None = None,
    *,
    dim: int = 64,
    tables: int = 3,
    probes: int = 2,
    cell_rows: int = 512,
    block_rows: int = 4096,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(x, y, cosine, rank): the k vectors of greatest cosine to every usable vector.

    ``vectors`` has vec_id and embedding; other columns are ignored. Vectors that are null,
    of another length, all zero or not finite, and rows without vec_id, take no part; a
    repeated vec_id counts once; ties go to the smaller id. An empty table gives no rows.
    Pairs are missed only where no table puts both vectors into one cell; the tests and
    the README measure the recall.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dim))
    n_rows = vectors.count()
    rows, links = single_rows(rows, k)
    coarse, fine, cells, expected = fit_cells(rows, n_rows, dim, tables, cell_rows, probes, max_cells, above=block_rows)
    shared = spark.sparkContext.broadcast((coarse, fine, cells, -(-expected // block_rows)))
    schema = T.StructType([*CODED.fields, T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("blocks", T.ArrayType(T.LongType()))])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse, fine, split, parts = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            codes, scales = quantise(np.stack(pdf["embedding"].to_numpy()))
            x = codes.astype(np.float32) * scales[:, None]
            per_table = coarse.shape[1] * fine.shape[1]
            at = np.concatenate([cells_of(x, coarse[t], fine[t], probes) + t * per_table for t in range(len(coarse))], axis=1)
            blocks = np.ones_like(at)
            if len(split):
                hit = np.minimum(np.searchsorted(split, at), len(split) - 1)
                blocks = np.where(split[hit] == at, parts[hit], 1)
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"], "code": [v.tobytes() for v in codes], "scale": scales, "cells": list(at), "blocks": list(blocks),
            })

    error = cosine_error(dim)
    least = None if min_cosine is None else min_cosine - error
    placed = rows.mapInPandas(place, schema)
    member = placed.select("vec_id", "code", "scale", F.explode(F.arrays_zip("cells", "blocks")).alias("c"))
    member = member.select("vec_id", "code", "scale", F.col("c.cells").alias("cell"), F.col("c.blocks").alias("blocks"))
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    member = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    member = member.select("vec_id", "code", "scale", "own", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("vec_id")
        ids, codes, scales = _unpack(pdf)
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        if i == j:
            return _lists(ids, *tile_neighbours(ids, codes, scales, k + SPARE, least))
        left = pdf["own"].to_numpy() == i
        one = _lists(ids, *tile_neighbours(ids, codes, scales, k + SPARE, least, left, ~left))
        two = _lists(ids, *tile_neighbours(ids, codes, scales, k + SPARE, least, ~left, left))
        return pd.concat([one, two])

    lists = member.groupBy("cell", "i", "j").applyInPandas(tile, LISTS)
    found = settled(merged_lists(lists, k, error, min_cosine), rows, k, min_cosine)
    w = Window.partitionBy("x").orderBy("y")
    return found.unionByName(links.withColumn("rank", F.row_number().over(w)))


def similar_to_queries(
    vectors: DataFrame, asks: Column, k: int = 5, *, dim: int = 64, block_rows: int = 16384
) -> DataFrame:
    """(x, y, cosine, rank): the exact k best of the rows for which ``asks`` holds, against all rows.

    Query blocks meet target blocks on a grid; each target is sent once per query block.
    Treats unusable, repeated and empty input as ``similar_vectors`` does.
    """
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dim))
    n = vectors.count()
    q = vectors.where(asks).count()
    nt, nq = max(1, math.ceil(n / block_rows)), max(1, math.ceil(q / block_rows))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    coded = _coded(rows)
    at = F.xxhash64("vec_id")
    targets = coded.select("*", F.lit(False).alias("asks"), F.pmod(at, F.lit(nt)).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"))
    queries = coded.where(asks).select("*", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("t"), F.pmod(at, F.lit(nq)).cast("int").alias("q"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, codes, scales = _unpack(pdf)
        mine = pdf["asks"].to_numpy()
        return _lists(ids, *tile_neighbours(ids, codes, scales, k + SPARE, None, mine, ~mine))

    lists = targets.unionByName(queries).groupBy("t", "q").applyInPandas(tile, LISTS)
    best = merged_lists(lists, k, cosine_error(dim)).select("x", F.explode("ys").alias("y"))
    return refined(best, rows, k)
