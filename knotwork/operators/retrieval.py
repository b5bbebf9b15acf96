"""Vector, keyword and hybrid retrieval, and graph-augmented search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.text import char_ngrams
from knotwork.operators.edges import confident, incident
from knotwork.runtime import staged

K1, B, RANK_SHIFT = 1.2, 0.75, 60


def unit_rows(pdf: pd.DataFrame, column: str = "e") -> np.ndarray:
    """The vectors of a frame as rows of a matrix, in double precision, of length 1; zero vectors stay zero."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[column]])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def comparable(c: Column) -> Column:
    """A vector without null or NaN values."""
    return c.isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def result_rows(**columns) -> pd.DataFrame:
    """A frame of results; ids of any type are kept as plain objects."""
    return pd.DataFrame({n: pd.Series(list(v), dtype=float if n in ("similarity", "score") else object) for n, v in columns.items()})


def nearest(queries: DataFrame, vectors: DataFrame, limit: int = 10, offset: int = 0, where: Column | None = None, block_rows: int = 4096) -> DataFrame:
    """(query_id, id, similarity, rank): the most similar vectors of every query, ties by id.

    ``queries``: query_id, embedding; ``vectors``: id, embedding and the columns of ``where``.
    An id may have several vectors, on either side; it counts by its best pair. A stated query
    set against all rows: blocks of queries meet blocks of vectors on a grid, each cell is one
    matrix product that keeps the best of every query, and these are merged. Only vectors of
    the query's length count; null ones and those with null or NaN values take no part.
    """
    v = vectors if where is None else vectors.where(where)
    v = v.where(comparable(F.col("embedding"))).select("id", F.col("embedding").cast("array<double>").alias("e"))
    q = queries.where(comparable(F.col("embedding"))).select("query_id", F.col("embedding").cast("array<double>").alias("e"))
    nv, nq = max(1, math.ceil(v.count() / block_rows)), max(1, math.ceil(q.count() / block_rows))
    at_i, at_j = F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")
    targets = v.select("id", "e", at_i.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("j"), F.size("e").alias("d"))
    asks = q.select("query_id", "e", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("i"), at_j.alias("j"), F.size("e").alias("d"))
    kind = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])
    most = limit + offset

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return result_rows(query_id=[], id=[], similarity=[])
        left, right = left.sort_values("query_id", kind="stable"), right.sort_values("id", kind="stable")
        a, b = unit_rows(left), unit_rows(right)
        asked, rows = np.unique(left["query_id"].to_numpy(), return_index=True)
        ids, cols = np.unique(right["id"].to_numpy(), return_index=True)
        out_q, out_i, out_s = [], [], []
        step = max(1, 512 * len(asked) // len(a))
        for g in range(0, len(asked), step):
            cut = rows[g : g + step]
            end = rows[g + step] if g + step < len(rows) else len(a)
            s = np.maximum.reduceat(a[cut[0] : end] @ b.T, cols, axis=1)
            s = np.round(np.maximum.reduceat(s, cut - cut[0], axis=0), 12)
            if s.shape[1] > most:  # with everything that ties with the last one kept
                last = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
                r, c = np.nonzero(s >= last[:, None])
            else:
                r, c = np.nonzero(np.ones(s.shape, dtype=bool))
            v = s[r, c]
            order = np.lexsort((c, -v, r))
            r, c, v = r[order], c[order], v[order]
            first = np.maximum.accumulate(np.where(np.r_[True, r[1:] != r[:-1]], np.arange(len(r)), 0))
            keep = np.arange(len(r)) - first < most
            out_q.append(asked[g + r[keep]]), out_i.append(ids[c[keep]]), out_s.append(v[keep])
        return result_rows(query_id=np.concatenate(out_q), id=np.concatenate(out_i), similarity=np.concatenate(out_s))

    found = asks.groupBy("i", "j", "d").cogroup(targets.groupBy("i", "j", "d")).applyInPandas(best, kind)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return out.where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset)


def tokens(text: Column, grams: int = 0) -> Column:
    """Lower-case words; with ``grams`` overlapping character n-grams, for scripts without blanks."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if not grams:
        return words
    return F.flatten(F.transform(words, lambda t: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - grams + 1)), lambda i: F.substring(t, i, F.lit(grams))
    )))


def _postings(queries: DataFrame, docs: DataFrame, grams: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, term) and (id, term, part): the terms of the queries, and the BM25 part of every term in every document."""
    d = docs.select("id", tokens(F.coalesce("text", F.lit("")), grams).alias("t"))
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text"), grams))).alias("term"))
    size = d.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("t")).alias("mean"))
    post = d.select("id", F.size("t").alias("n"), F.explode("t").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = staged(post.groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = tf.join(df, "term").join(F.broadcast(size), F.lit(True))  # size is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return q, s.select("id", "term", part.alias("part"))


def keyword_top(queries: DataFrame, docs: DataFrame, limit: int, grams: int = 0, block_rows: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the documents of greatest BM25 score of every query, ties by id.

    ``queries``: query_id, text; ``docs``: id, text. Lengths and document frequencies are those
    of all documents. Blocks of queries meet blocks of documents on a grid, each cell is one
    product of sparse matrices (query x term, term x document) that keeps the best of every
    query, so a term that most documents hold never gathers its postings in one place.
    """
    q, post = _postings(queries, docs, grams)
    q = q.withColumn("t", F.xxhash64("term")).select("query_id", "t")
    post = post.withColumn("t", F.xxhash64("term")).select("id", "t", "part")
    nq, nd = max(1, math.ceil(queries.count() / block_rows)), max(1, math.ceil(docs.count() / block_rows))
    left = q.select("query_id", "t", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("i"))
    right = post.select("id", "t", "part", F.pmod(F.xxhash64("id"), F.lit(nd)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("j"))
    kind = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", docs.schema["id"].dataType), T.StructField("score", T.DoubleType()),
    ])

    def best(asks: pd.DataFrame, posts: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(posts):
            return result_rows(query_id=[], id=[], score=[])
        ids, at = np.unique(posts["id"].to_numpy(), return_inverse=True)
        order = np.argsort(posts["t"].to_numpy(), kind="stable")
        terms, at, part = posts["t"].to_numpy()[order], at[order], posts["part"].to_numpy()[order]
        asks = asks.sort_values(["query_id", "t"], kind="stable")
        lo, hi = np.searchsorted(terms, asks["t"].to_numpy(), "left"), np.searchsorted(terms, asks["t"].to_numpy(), "right")
        of_query = asks["query_id"].to_numpy()
        cut = np.flatnonzero(np.r_[True, of_query[1:] != of_query[:-1]])
        out_q, out_i, out_s = [], [], []
        for a, b in zip(cut, np.r_[cut[1:], len(asks)], strict=True):
            score = np.zeros(len(ids))
            for x, y in zip(lo[a:b], hi[a:b], strict=True):
                score[at[x:y]] += part[x:y]  # a document holds a term once
            hit = np.flatnonzero(score > 0)
            hit = hit[np.lexsort((hit, -np.round(score[hit], 6)))[:limit]]
            out_q += [of_query[a]] * len(hit)
            out_i.append(ids[hit]), out_s.append(score[hit])
        return result_rows(query_id=out_q, id=np.concatenate(out_i), score=np.concatenate(out_s))

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, kind)
    return ranked(found, "score", limit)


def ranked(scores: DataFrame, column: str, limit: int) -> DataFrame:
    """Scores with their rank, rounded before the order is taken so that it is reproducible."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(column, 6)), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fused(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank) by reciprocal ranks: alpha for the vector side, 1 - alpha for keywords."""
    v = vector.select("query_id", "id", F.col("rank").alias("rv"))
    k = keyword.select("query_id", "id", F.col("rank").alias("rk"))
    score = F.coalesce(alpha / (RANK_SHIFT + F.col("rv")), F.lit(0.0)) + F.coalesce((1 - alpha) / (RANK_SHIFT + F.col("rk")), F.lit(0.0))
    return ranked(v.join(k, ["query_id", "id"], "full").withColumn("score", score).drop("rv", "rk"), "score", limit)


def containing_nodes(mentions: DataFrame, nodes: DataFrame, per_mention: int) -> DataFrame:
    """(query_id, node_id): per mention (query_id, m, type) up to ``per_mention`` nodes of its type whose text contains it.

    A mention meets the nodes over its first trigram (its first character, if it is shorter),
    and only distinct texts meet; most occurrences come first, then the smaller node_id.
    """
    first = F.substring("m", 1, F.when(F.length("m") >= 3, F.lit(3)).otherwise(F.lit(1)))
    kinds = mentions.select("m", "type").where("m <> ''").distinct().withColumn("gram", first)
    n = nodes.select("node_id", F.lower("text").alias("t"), "type", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))
    grams = n.select("*", F.explode(F.array_union(char_ngrams(F.col("t")), char_ngrams(F.col("t"), 1))).alias("gram"))
    w = Window.partitionBy("m", "type").orderBy(F.desc("occurrences"), "node_id")
    met = kinds.join(grams, ["type", "gram"]).where(F.contains("t", "m")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_mention)
    return mentions.join(met.select("m", "type", "node_id"), ["m", "type"]).select("query_id", "node_id").distinct()


def graph_augmented(hits: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 10, min_confidence: float = 0.5, per_mention: int = 5) -> DataFrame:
    """(query_id, document_id, result_type, rank): retrieval hits first, then documents found over the graph.

    ``hits``: query_id, document_id, rank; ``mentions``: query_id, text, type. A mention
    meets up to ``per_mention`` nodes of its type whose text contains it (most occurrences
    first); their neighbours' documents that are no hits follow, by confidence. At most
    2 * limit rows per query; queries without hits get none.
    """
    m = mentions.select("query_id", F.lower("text").alias("m"), "type").distinct()
    near = containing_nodes(m, nodes, per_mention).join(incident(confident(edges, min_confidence)), "node_id")
    docs = near.join(nodes.select(F.col("node_id").alias("neighbour_id"), "documents"), "neighbour_id").select(
        "query_id", "confidence", F.explode("documents").alias("document_id")
    ).where("document_id is not null").groupBy("query_id", "document_id").agg(F.max("confidence").alias("confidence"))
    docs = docs.join(hits.select("query_id", "document_id"), ["query_id", "document_id"], "left_anti")
    docs = docs.join(hits.select("query_id").distinct(), "query_id", "left_semi")
    both = hits.select("query_id", "document_id", F.lit("vector").alias("result_type"), F.lit(0).alias("part"), F.col("rank").cast("double").alias("o")).unionByName(
        docs.select("query_id", "document_id", F.lit("knowledge_graph").alias("result_type"), F.lit(1).alias("part"), (-F.col("confidence")).alias("o"))
    )
    w = Window.partitionBy("query_id").orderBy("part", "o", "document_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * limit).select("query_id", "document_id", "result_type", "rank")


def similarity_edges(vectors: DataFrame, threshold: float = 0.7, kind: str | None = None, strict: bool = True, block_rows: int = 4096) -> DataFrame:
    """(a, b, similarity): every pair of vectors with a cosine above ``threshold`` (at least it, if not ``strict``), a < b.

    ``vectors``: id, embedding and, if named, the column ``kind`` that both vectors of a pair
    agree in. Blocks of vectors meet on a grid, one matrix product per cell. Null vectors and
    those with null or NaN values take no part, vectors of different length make no pair.
    """
    label = F.col(kind).cast("string") if kind else F.lit("")
    v = vectors.where(comparable(F.col("embedding"))).select("id", F.col("embedding").cast("array<double>").alias("e"), label.alias("kind")).where("kind is not null")
    n = max(1, math.ceil(v.count() / block_rows))
    v = v.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    v = v.select("id", "e", "kind", "own", F.size("e").alias("d"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    id_type = vectors.schema["id"].dataType
    out = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("similarity", T.DoubleType())])

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left = pdf if alone else pdf[pdf["own"] == pdf["i"]]
        right = pdf if alone else pdf[pdf["own"] == pdf["j"]]
        if not len(left) or not len(right):
            return result_rows(a=[], b=[], similarity=[])
        x, y, ia, ib = unit_rows(left), unit_rows(right), left["id"].to_numpy(), right["id"].to_numpy()
        rows, cols, values = [], [], []
        for at in range(0, len(x), 512):
            s = x[at : at + 512] @ y.T
            r, c = np.nonzero(s > threshold if strict else s >= threshold)
            rows.append(r + at), cols.append(c), values.append(s[r, c])
        r, c, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
        one, two = ia[r], ib[c]
        keep = one < two if alone else one != two
        one, two, s = one[keep], two[keep], s[keep]
        return result_rows(a=np.where(one < two, one, two), b=np.where(one < two, two, one), similarity=s)

    return v.groupBy("kind", "d", "i", "j").applyInPandas(pairs, out)
