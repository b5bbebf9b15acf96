"""Store and pipeline statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_statistics(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): rows of the store, distinct documents, chunks and entities by type."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")

    out = one("chunks", chunks).unionByName(one("entities", nodes)).unionByName(one("relationships", edges))
    docs = chunks.agg(F.countDistinct("document_id").alias("value")).select(F.lit("documents").alias("metric"), "value")
    kinds = chunks.groupBy("document_type").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("chunks:"), F.coalesce("document_type", F.lit("unknown"))).alias("metric"), "value")
    types = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("entities:"), "type").alias("metric"), "value")
    return out.unionByName(docs).unionByName(kinds).unionByName(types)


def document_counters(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, mentions, nodes, edges): per-document results of the pipeline."""
    m = mentions.groupBy("document_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct(F.lower("text"), "type").alias("nodes"))
    e = edges.select(F.explode("documents").alias("document_id"), "edge_id").groupBy("document_id").agg(F.countDistinct("edge_id").alias("edges"))
    return m.join(e, "document_id", "full").na.fill(0, ["mentions", "nodes", "edges"])


def corpus_counters(counters: DataFrame) -> DataFrame:
    return counters.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("mentions").alias("mentions"), F.sum("nodes").alias("nodes_touched"), F.sum("edges").alias("edges_touched")
    )
