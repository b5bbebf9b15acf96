"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import leakage, lookalike, names, neighbours, packing, scans
from knotwork.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_pairs(names.entities(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "nicknames")))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "nicknames"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cases = scans.repairs(table(spark, sf_dir, "chunks"))
    return cases.select("chunk_id", "line_no", "kind", "word").distinct()


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_pages(table(spark, sf_dir, "chunks"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_paragraphs(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.similar_vectors(table(spark, sf_dir, "chunk_vectors"), 5, 0.80)
    return near.select(
        F.least("x", "y").alias("vec_id_a"), F.greatest("x", "y").alias("vec_id_b")
    ).distinct()


def p4_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact five best of every vector whose id is divisible by 20, against all vectors."""
    best = neighbours.similar_to_queries(table(spark, sf_dir, "chunk_vectors"), F.col("vec_id") % 20 == 0, 5)
    return best.select(
        F.col("x").alias("vec_id"), F.col("y").alias("neighbour"), F.round("cosine", 6).alias("cosine"),
        F.col("rank").cast("long").alias("rank"),
    )


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_windows(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return spans.select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.without_leaks(docs, leakage.leaked_spans(docs, table(spark, sf_dir, "eval_items")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, sf_dir, "documents"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_classes(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "form")


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p3_found": p3_found,
    "p3_pages": p3_pages,
    "p3_paragraphs": p3_paragraphs,
    "p4_found": p4_found,
    "p4_queries": p4_queries,
    "p6_windows": p6_windows,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_cleaned": p7_cleaned,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_forms": p8_forms,
}

ORACLE = {
    "p4_found": """
        WITH v AS (
          SELECT vec_id, any_value(embedding::DOUBLE[]) AS e FROM chunk_vectors
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
          GROUP BY vec_id),
        s AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
        SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM k WHERE c >= 0.80""",
    "p4_queries": """
        WITH v AS (
          SELECT vec_id, any_value(embedding::DOUBLE[]) AS e FROM chunk_vectors
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
          GROUP BY vec_id),
        s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS c
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT vec_id, neighbour, round(c, 6) AS cosine, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour) AS rank FROM s)
        WHERE rank <= 5""",
}
